"""Operators for large-scale training-data pipelines, built on Spark DataFrames.

Nothing else in the library imports this subpackage; it may be removed as a whole.
"""
