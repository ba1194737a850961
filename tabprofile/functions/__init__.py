"""Column expressions: reading cells, text clean-up, value patterns."""
