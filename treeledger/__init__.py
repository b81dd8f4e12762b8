"""Source-code analytics on Spark."""
