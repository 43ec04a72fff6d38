"""Operators for large-scale training-data pipelines (see README.md)."""
