"""Small statistical expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def binomial_stderr(p: Column, n: Column) -> Column:
    """Sample standard error of a 0/1 mean; null when fewer than two rows."""
    return F.sqrt(F.try_divide(p * (1 - p), n - 1))


def sample_margin(p: Column, n: Column, z: float = 1.0) -> Column:
    """Half-width of the binomial interval of a score from a subsample."""
    return z * F.sqrt(F.try_divide(p * (1 - p), n))


def share(condition: Column) -> Column:
    """Fraction of rows for which a condition holds; null counts as false."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("int"))


def time_per_output_token(e2e_ms: Column, ttft_ms: Column, out_tokens: Column) -> Column:
    """Decode time per token after the first; null for one-token replies."""
    return F.when(out_tokens > 1, (e2e_ms - ttft_ms) / (out_tokens - 1))


def gain(current: Column, previous: Column) -> Column:
    """Relative change against an earlier value."""
    return F.try_divide(current - previous, previous)
