"""Path-and-value search, its statistics and its storage layout, on Spark."""
