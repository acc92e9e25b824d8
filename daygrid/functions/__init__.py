"""Column expressions: calendar, text and statistics."""
