"""Column functions of the market-panel engine."""
