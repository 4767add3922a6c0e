"""Operators: DataFrames and small parameters in, DataFrames out."""
