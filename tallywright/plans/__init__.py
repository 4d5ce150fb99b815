"""End-to-end analyses composed of operators."""
