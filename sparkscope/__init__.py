"""Spark-native analytics over telemetry: metrics, spans and their catalogues."""
