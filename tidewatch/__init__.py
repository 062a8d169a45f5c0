"""Network-traffic detection analytics as Spark DataFrame jobs."""
