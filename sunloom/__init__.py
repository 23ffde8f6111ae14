"""Photovoltaic telemetry analytics as Spark DataFrame operators and jobs."""
