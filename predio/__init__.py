"""Land-subdivision analytics as Spark DataFrame jobs."""
