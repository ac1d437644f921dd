"""Column expressions and shared DataFrame building blocks."""
