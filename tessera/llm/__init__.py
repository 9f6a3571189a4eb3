"""Operators for preparing training data: one module per operator, ``queries`` binds them to tables."""
