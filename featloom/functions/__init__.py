"""Column expressions: no jobs run here."""
