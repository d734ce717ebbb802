"""Spark-native text index, link graph, hybrid retrieval and corpus data quality operators."""

__version__ = "0.1.0"
