"""Column functions: text, names, identifiers and vectors."""
