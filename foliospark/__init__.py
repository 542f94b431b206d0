"""Spark-native processing of long documents and training text."""

__version__ = "0.1.0"
