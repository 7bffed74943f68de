"""Column functions: text, lists, vectors, dates and tolerant JSON."""
