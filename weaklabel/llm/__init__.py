"""Operators for large-scale training data. Nothing outside this package imports it."""
