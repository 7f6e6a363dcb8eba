"""Hybrid retrieval and data processing on Spark: keyword, symbol, path and vector search over collections of files."""

__version__ = "0.1.0"
