"""Spark-native document retrieval and grounded analytics."""

__version__ = "0.1.0"
