"""Column expressions and row numbers."""
