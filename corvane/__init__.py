"""Corvane: a PySpark-native engine for document retrieval and grounded-answer preparation."""

__version__ = "0.1.0"
