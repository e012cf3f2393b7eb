"""Column expressions: market time, text, scores."""
