"""plans of the market-panel engine."""
