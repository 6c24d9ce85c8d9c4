"""operators of the market-panel engine."""
