"""Responses to leaderboard, with the gates that qualify its numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.functions.statistics import share
from tallywright.operators import scoring


def quality_leaderboard(responses: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """Model x benchmark table from raw responses."""
    scored = scoring.score_responses(responses)
    scores = scoring.score_summary(scored, ["system", "task"], "ok_line")
    return scoring.leaderboard(scores, tasks)


def quality_card(
    responses: DataFrame, gap_limit: float = 0.05, null_limit: float = 0.1
) -> DataFrame:
    """Score, error, truncation and extractor gates per model and benchmark.

    One scan and one shuffle: all measures are aggregates over the same rows.
    """
    scored = scoring.score_responses(responses)
    hit = F.col("ok_line").cast("int")
    card = scored.groupBy("system", "task").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(hit).alias("score"),
        (F.stddev_samp(hit) / F.sqrt(F.count(F.lit(1)))).alias("stderr"),
        share(F.col("content").isNull()).alias("null_rate"),
        share(F.col("pred_line").eqNullSafe(F.col("pred_fallback"))).alias("agreement"),
        (F.avg(hit) - F.avg(F.col("ok_fallback").cast("int"))).alias("score_gap"),
    )
    trusted = (F.abs("score_gap") <= gap_limit) & (F.col("null_rate") <= null_limit)
    return card.withColumn("trusted", trusted)
