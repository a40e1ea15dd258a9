"""Spark-native spatial analytics and corpus preparation."""

__version__ = "0.1.0"
