"""Readers of benchmark artefacts and sinks for derived tables."""
