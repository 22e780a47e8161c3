"""Document-reading analytics and corpus preparation on Spark."""
