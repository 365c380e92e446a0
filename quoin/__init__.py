"""quoin: a PySpark-native engine for editorial feeds and text corpora."""

__version__ = "0.1.0"
