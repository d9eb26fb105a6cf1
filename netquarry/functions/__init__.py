"""Column expressions: geometry and other scalars."""
