"""Operators: DataFrames in, a DataFrame out, no state."""
