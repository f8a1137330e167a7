"""PySpark-native catalogue analytics, hybrid search and entity matching."""

__version__ = "0.1.0"
