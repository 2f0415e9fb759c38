"""Lodestone: Spark-native indexing, retrieval and data-quality operators for large code and text collections."""

__version__ = "0.1.0"
