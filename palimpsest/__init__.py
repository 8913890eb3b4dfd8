"""Spark-first analytics over revisions of documents."""

__version__ = "0.2.0"
