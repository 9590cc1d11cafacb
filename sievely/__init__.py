"""Sievely: a Spark-native engine that answers plain-language questions over text corpora."""

__version__ = "0.1.0"
