"""Millrace: entity-resolution blocking on Spark, expressed as DataFrame plans."""

__version__ = "0.1.0"
