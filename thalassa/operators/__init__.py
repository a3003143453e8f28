"""Operators: DataFrames or Columns in, DataFrames or Columns out."""
