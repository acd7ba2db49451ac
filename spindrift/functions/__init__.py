"""Column functions: text, identifiers and vectors."""
