"""Levels of a throughput sweep to its summary line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.operators import throughput
from tallywright.operators.keys import join_on


def sweep_summary(
    levels: DataFrame, threshold: float = throughput.PLATEAU_GAIN,
    slo: float = throughput.INTERACTIVE_TPOT_MS, cost: float = throughput.COSTLY_TTFT_RATIO,
) -> DataFrame:
    """Single-stream rate, plateau, peaks and operating point per system.

    Expects ``system, concurrency, out_tok_s, ttft_ms, tpot_ms``.
    """
    single = levels.groupBy("system").agg(
        F.min_by("out_tok_s", "concurrency").alias("single_stream"),
        F.count(F.lit(1)).alias("n_levels"),
    )
    parts = [
        throughput.find_plateau(levels, threshold=threshold).select(
            "system", "plateau_level", "state"
        ),
        throughput.claim_type(levels, threshold=threshold, cost=cost),
        throughput.slo_operating_point(levels, slo=slo),
    ]
    for part in parts:
        single = join_on(single, part, ["system"], "inner")
    return single
