"""Analytics operators: DataFrames in, DataFrames out."""
