"""Operators: each takes DataFrames and returns a lazily planned DataFrame."""
