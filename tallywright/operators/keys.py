"""Shared helpers for key columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, null_safe: bool = True
) -> DataFrame:
    """Equi-join that keeps one copy of each key.

    Grouping columns may be null and then match each other; for item ids, which
    identify nothing when null, ``null_safe=False`` gives plain equality and
    lets Spark reuse a partitioning by those ids.

    No broadcast hint is given: Spark broadcasts a side only after checking its
    size against ``spark.sql.autoBroadcastJoinThreshold`` (before the job or,
    under adaptive execution, from the measured shuffle) and otherwise merges.
    """
    l, r = left.alias("l"), right.alias("r")
    condition = reduce(
        lambda a, b: a & b,
        (
            F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`"))
            if null_safe
            else F.col(f"l.`{k}`") == F.col(f"r.`{k}`")
            for k in keys
        ),
    )
    joined = l.join(r, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    outer = how in ("full", "full_outer", "outer", "right", "right_outer")
    keep = [
        (F.coalesce(F.col(f"l.`{k}`"), F.col(f"r.`{k}`")) if outer else F.col(f"l.`{k}`")).alias(k)
        for k in keys
    ]
    keep += [F.col(f"l.`{c}`") for c in left.columns if c not in keys]
    keep += [F.col(f"r.`{c}`") for c in right.columns if c not in keys]
    return joined.select(*keep)
