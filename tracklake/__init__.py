"""Spark-native playlist retrieval and recommendation analytics."""

__version__ = "0.1.0"
