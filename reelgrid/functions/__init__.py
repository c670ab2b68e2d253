"""Column expressions of single rows."""
