"""Column expressions: no function here reads data."""
