"""Column expressions: DataFrame-free building blocks."""
