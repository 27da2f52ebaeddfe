"""Column expressions and skew-safe ordered computations."""
