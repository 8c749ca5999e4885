"""Column expressions and Arrow block helpers shared by the operators."""
