"""A Spark-native engine for manifold-valued data."""

__version__ = "0.1.0"
