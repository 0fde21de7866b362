"""Flow-graph anomaly analytics as Spark DataFrame jobs."""
