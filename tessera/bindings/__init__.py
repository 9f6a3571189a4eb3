"""Queries over the given tables, one module per family of operators."""
