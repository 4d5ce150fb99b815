"""Operators of a training-data pipeline: rules, near-duplicates, personal data, packing, mixing.

Nothing else in the library imports this subpackage.
"""
