"""Tesserae: a Spark-native engine for document knowledge bases."""

__version__ = "0.1.0"
