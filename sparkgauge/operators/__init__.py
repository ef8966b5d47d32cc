"""Operators: DataFrames in, DataFrames out, all lazy."""
