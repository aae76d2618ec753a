"""Out-of-sample projection analytics as Spark DataFrame jobs."""
