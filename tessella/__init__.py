"""Spark-native analytics over data-sharing disclosures."""

__version__ = "0.1.0"
