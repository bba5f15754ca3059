"""Source-repository analytics on Spark."""
