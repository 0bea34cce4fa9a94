"""Spark-native analytics over large collections of fragmentary, line-structured documents."""

__version__ = "0.1.0"
