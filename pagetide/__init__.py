"""Page-log analytics on Spark."""
