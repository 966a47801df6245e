"""Recallium: a Spark-first analytics engine for memory and retrieval corpora."""

__version__ = "0.1.0"
