"""Column expressions and small closed-form statistics."""
