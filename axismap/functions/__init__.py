"""Column expressions over runs."""
