"""Operators that Spark's API lacks, composed of those it has."""
