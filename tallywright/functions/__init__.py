"""Column expressions: parsing, answer extraction and statistics."""
