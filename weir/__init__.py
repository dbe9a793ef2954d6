"""weir: analytics over agent and model traffic on Spark."""
