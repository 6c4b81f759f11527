"""Market panels, a fuzzy-rule scorer and its evaluation on Spark."""
