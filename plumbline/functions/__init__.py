"""Column expressions that look at one row only."""
