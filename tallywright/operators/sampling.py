"""Repeatable samples, slices and small probes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallywright.operators.keys import join_on


def _seeded(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """The same n items on every cluster: the n smallest seeded hashes.

    Spark keeps only the n best rows of each partition, so the full table is
    never sorted or shuffled.
    """
    return df.orderBy(_seeded(id_col, seed), id_col).limit(n)


def slice_bias(
    df: DataFrame, id_col: str, stratum: str, n: int, seed: int
) -> DataFrame:
    """Composition of the first n items against a seeded sample of n; of all items if fewer exist."""

    def mix(part: DataFrame, name: str) -> DataFrame:
        counts = part.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
        return counts.select(stratum, (F.col("_n") / F.sum("_n").over(Window.partitionBy())).alias(name))

    cols = df.select(id_col, stratum)
    first = mix(cols.orderBy(id_col).limit(n), "slice_share")
    sampled = mix(seeded_sample(cols, id_col, n, seed), "sample_share")
    both = join_on(first, sampled, [stratum], "full")
    zero = F.lit(0.0)
    return both.select(
        stratum,
        F.coalesce("slice_share", zero).alias("slice_share"),
        F.coalesce("sample_share", zero).alias("sample_share"),
        (F.coalesce("slice_share", zero) - F.coalesce("sample_share", zero)).alias("bias"),
    )


def order_levels(levels: DataFrame, system: str = "system", level: str = "concurrency") -> DataFrame:
    """Curves in reading order."""
    return levels.orderBy(system, level)


def top_k(df: DataFrame, value: str, k: int, tie: Sequence[str]) -> DataFrame:
    """The k highest rows; ties follow the given columns."""
    return df.orderBy(F.col(value).desc(), *tie).limit(k)


def probe(df: DataFrame, id_col: str, seconds: str, n: int) -> DataFrame:
    """Mean cost of the first n items and the time the whole table would take."""
    items = df.agg(F.count(F.lit(1))).scalar()
    return (
        df.select(id_col, seconds)
        .orderBy(id_col)
        .limit(n)
        .agg(
            F.count(F.lit(1)).alias("probed"),
            F.max(items).alias("items"),
            F.avg(seconds).alias("mean_seconds"),
        )
        .withColumn("projected_hours", F.col("mean_seconds") * F.col("items") / 3600)
    )
