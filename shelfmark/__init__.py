"""Shelfmark: a PySpark-native engine for library and collection data."""

__version__ = "0.1.0"
