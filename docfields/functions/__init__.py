"""Column expressions and distributed building blocks."""
