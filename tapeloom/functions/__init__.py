"""Column expressions: clocks and window frames."""
