"""Spark-native text, retrieval and entity analytics."""

__version__ = "0.1.0"
