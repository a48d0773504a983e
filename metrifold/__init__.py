"""Telemetry analytics on Spark: long sample tables and DataFrame operators over them."""
