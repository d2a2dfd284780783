"""Column expressions and order/quantile building blocks."""
