"""Column expressions: box geometry, scores, value normalisers, text extraction."""
