"""Column expressions and plain sequence functions."""
