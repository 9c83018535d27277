"""Column expressions: paths, lines, text, tokens, scores."""
