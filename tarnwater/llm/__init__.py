"""Operators for large text corpora, with their queries and SQL."""
