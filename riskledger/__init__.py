"""Transaction risk scoring and business-finance analytics as Spark DataFrame jobs."""
