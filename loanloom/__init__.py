"""Credit analytics on Spark: ingestion, features, decisions, scoring and reports as DataFrame jobs."""
