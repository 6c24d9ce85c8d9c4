"""sources of the market-panel engine."""
