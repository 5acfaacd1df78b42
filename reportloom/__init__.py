"""Structured-report analytics expressed as Spark DataFrame plans."""
