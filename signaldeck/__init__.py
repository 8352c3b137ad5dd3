"""signaldeck: telemetry analytics as PySpark DataFrame operators."""
