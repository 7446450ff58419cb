"""Weftline: a Spark-native engine for declarative data pipelines and training-data preparation."""

__version__ = "0.1.0"
