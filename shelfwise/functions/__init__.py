"""Column expressions and fixed lookup tables shared by the operators."""
