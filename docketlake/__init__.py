"""Spark-native document retrieval, evaluation and corpus preparation."""

__version__ = "0.1.0"
