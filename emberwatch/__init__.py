"""Security-telemetry analytics as PySpark DataFrame jobs."""
