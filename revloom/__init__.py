"""Change-history analytics on Spark."""
