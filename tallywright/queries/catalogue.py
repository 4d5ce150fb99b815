"""Imports every query module so that its queries are registered."""

from tallywright.queries import agentic, analyses, live, quality, records, serving, text  # noqa: F401
from tallywright.queries.registry import QUERIES, SQL  # noqa: F401
