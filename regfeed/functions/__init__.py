"""Column expressions: identity, time, text and event cards."""
