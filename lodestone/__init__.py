"""Spark-first analytics and record-integration engine."""

__version__ = "0.1.0"
