"""Column expressions on intervals."""
