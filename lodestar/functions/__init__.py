"""Column expressions: tokens, scores, dates and vectors."""
