"""Column builders: each takes columns and a window, and returns a column."""
