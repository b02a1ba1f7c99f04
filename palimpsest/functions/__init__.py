"""Column expressions: scoring, text, time, identifiers. No Python runs per row."""
