"""Spark-first analytics over incrementally collected, nested event data."""
