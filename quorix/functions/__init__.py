"""Column expressions and numpy special functions."""
