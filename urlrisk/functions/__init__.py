"""Column expressions: text statistics, URL parts, labels, advice text."""
