"""codelode: a PySpark-native engine for searching code and preparing text corpora."""

__version__ = "0.1.0"
