"""Spark-native analytics for labelled short-audio datasets."""

__version__ = "0.1.0"
