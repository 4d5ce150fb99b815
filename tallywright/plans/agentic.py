"""Attempts of resumed runs to comparable, qualified verdict scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.functions.statistics import sample_margin
from tallywright.operators import verdicts
from tallywright.operators.trust import failure_class


def verdict_card(
    attempts: DataFrame, order: Sequence[str], resolved_status: str,
    classes: dict[str, str], status: str = "status",
) -> DataFrame:
    """Resolved share, margin and blame per system, from the latest attempts.

    Expects ``system, instance`` and the status; one shuffle settles the items,
    a second one, of partial counts only, sums them up.
    """
    last = verdicts.last_status_wins(attempts, ["system", "instance"], order, [status])
    blame = failure_class(F.col(status), classes)
    n, ok = F.count(F.lit(1)), F.count_if(F.col(status) == resolved_status)
    card = last.groupBy("system").agg(
        n.alias("n"),
        ok.alias("resolved"),
        F.sum("n_attempts").cast("bigint").alias("n_attempts"),
        F.count_if(blame == "infra").alias("infra_failures"),
    )
    rate = F.try_divide(F.col("resolved"), F.col("n"))
    return card.withColumn("rate", rate).withColumn("margin", sample_margin(rate, F.col("n")))
