"""Document-vault analytics on Spark."""
