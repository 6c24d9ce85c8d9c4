"""streaming of the market-panel engine."""
