"""Convena: a Spark-native engine that collects, resolves, de-duplicates, reviews and publishes event records."""

__version__ = "0.1.0"
