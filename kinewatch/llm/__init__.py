"""Operators for training-data corpora, their queries and SQL. Nothing else in the package imports this."""
