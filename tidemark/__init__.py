"""Spark-first analytics for event listings."""
