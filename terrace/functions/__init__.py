"""Scalar functions as column expressions, and functions over partitions and groups."""
