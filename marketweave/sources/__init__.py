"""Sources of the market engine."""
