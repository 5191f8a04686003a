"""Spark-first analytics over claim-to-evidence matrices."""

__version__ = "0.1.0"
