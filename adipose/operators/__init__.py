"""The data work: DataFrames in, DataFrames out."""
