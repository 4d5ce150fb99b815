"""Best-of-N candidates and iterate-until-green rounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.operators.quantiles import exact_quantiles
from tallywright.operators.running import running


def pick_champion(
    candidates: DataFrame, keys: Sequence[str], candidate: str, score: str
) -> DataFrame:
    """Best candidate per problem; the lower number wins a tie.

    Candidates without a score do not compete; a problem in which none has one
    keeps a row with nulls.
    """
    order = F.when(
        F.col(score).isNotNull(), F.struct(F.col(score), (-F.col(candidate)).alias("neg"))
    )
    return candidates.groupBy(*keys).agg(
        F.max_by(candidate, order).alias("champion"),
        F.max(score).alias("best_score"),
        F.count(score).alias("n_scored"),
    )


def round_progress(
    rounds: DataFrame, keys: Sequence[str], round_no: str, value: str, green: Column
) -> DataFrame:
    """Rounds to green, first and last value, and the ratio between them."""
    first, last = F.min_by(value, round_no), F.max_by(value, round_no)
    return rounds.groupBy(*keys).agg(
        F.min(F.when(green, F.col(round_no))).alias("rounds_to_green"),
        F.max(round_no).alias("last_round"),
        first.alias("first_value"),
        last.alias("last_value"),
        F.try_divide(last, first).alias("improvement"),
    )


def work_before_abort(
    steps: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, abort: Column,
    at_least: int = 3,
) -> DataFrame:
    """Successful steps each aborted instance made before its first abort.

    Returns one row: aborted instances, the median of their step counts, and
    how many made at least ``at_least`` steps.
    """
    flag = F.when(F.coalesce(abort, F.lit(False)), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    seen = running(steps, keys, order, chunk, sums={"_aborts": flag})
    per_instance = seen.groupBy(*keys).agg(
        F.count_if(F.col("_aborts") == 0).alias("steps"), F.max("_aborts").alias("_aborts")
    ).where(F.col("_aborts") > 0).select("steps", F.lit(1).alias("_all"))
    median = exact_quantiles(per_instance, ["_all"], "steps", {"median_steps": 0.5})
    working = per_instance.agg(F.count_if(F.col("steps") >= at_least)).scalar()
    return median.select(F.col("n").alias("aborted"), "median_steps", working.alias("working"))
