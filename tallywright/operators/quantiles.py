"""Exact percentiles of groups of any size.

Spark's ``percentile`` gathers a group's distinct values in one task. Here two
passes replace that gathering: the first counts rows per narrow value bucket
and finds the buckets that hold the wanted ranks; the second orders only those
buckets, after equal values have been merged into counts. A bucket that holds
too much for one task, because values lie close together, is first split at
its own approximate quantiles, again and again: each round keeps the part of it
that holds the rank, at most a few hundredths. The table of wanted
buckets is written out in between: it is small unless there are very many
groups, so the second pass filters the scan with a broadcast join and shuffles
only the rows of those buckets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.operators.keys import join_on
from tallywright.workspace import settle

# Buckets per e-fold of magnitude: each spans about 0.006% of its value.
RESOLUTION = 16384
# A bucket of more rows, unless they are all equal, is split at this many places.
MOST_ROWS, SPLITS, ACCURACY = 1 << 16, 63, 1000
# Infinities share the bucket of the largest finite values.
LARGEST = 1.7e308


def _bucket(v: Column) -> Column:
    """A value's bucket; never decreases as the value grows."""
    size = F.least(F.abs(v), F.lit(LARGEST))
    return (F.signum(v) * F.floor(F.log1p(size) * RESOLUTION)).cast("bigint")


def _ranks(p: float, n: Column, rule: str) -> list[Column]:
    """Zero-based positions in the sorted group that a percentile needs."""
    if rule == "index":
        return [F.least(F.floor(n * p), n - 1).cast("bigint")]
    position = (n - 1) * F.lit(float(p))
    return [F.floor(position).cast("bigint"), F.ceil(position).cast("bigint")]


def _ranks_inside(ranks: Column) -> Column:
    return F.filter(ranks, lambda r: (r >= F.col("_lo")) & (r < F.col("_hi")))


def _narrowed(base: DataFrame, wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The parts of wide brackets that hold their ranks.

    A bracket is cut at approximate quantiles of its own rows, a mergeable sketch. Rows equal to a
    cut are a part of their own, so a value that fills a bracket is found and what is left shrinks.
    """
    bracket = [*keys, "_b", "_from", "_to"]
    rows = join_on(base, wide, [*keys, "_b"], "inner").where(F.col("_v").between(F.col("_from"), F.col("_to")))
    shares = [(k + 1) / (SPLITS + 1) for k in range(SPLITS)]
    cuts = rows.groupBy(*bracket).agg(F.percentile_approx("_v", shares, ACCURACY).alias("_cuts"))
    cuts = settle(cuts, "quantile-cuts")
    place = F.size(F.filter("_cuts", lambda c: c < F.col("_v"))) + F.size(F.filter("_cuts", lambda c: c <= F.col("_v")))
    parts = join_on(rows, cuts, bracket, "inner").groupBy(*bracket, "n", "_lo", "_ranks", place.alias("_part")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
    )
    # At most 2 * SPLITS + 1 rows a bracket.
    along = Window.partitionBy(*bracket).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = parts.withColumn("_hi", F.col("_lo") + F.sum("_c").over(along)).withColumn("_lo", F.col("_hi") - F.col("_c"))
    return placed.select(
        *keys, "_b", "n", "_lo", _ranks_inside(F.col("_ranks")).alias("_ranks"), "_c",
        F.col("_low").alias("_from"), F.col("_high").alias("_to"),
    ).where(F.size("_ranks") > 0)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    rule: str = "interpolated",
    most_rows: int = MOST_ROWS,
) -> DataFrame:
    """One row per group: ``n`` and one column per named percentile.

    ``rule="interpolated"`` interpolates linearly between neighbours,
    ``rule="index"`` takes element ``int(p * n)`` of the sorted group.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    base = df.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    base = base.withColumn("_b", _bucket(F.col("_v")))

    along = Window.partitionBy(*keys).orderBy("_b")
    histogram = base.groupBy(*keys, "_b").agg(
        F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_from"), F.max("_v").alias("_to")
    )
    histogram = histogram.select(
        *keys,
        "_b",
        "_from",
        "_to",
        F.sum("_c").over(Window.partitionBy(*keys)).alias("n"),
        F.sum("_c")
        .over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        .alias("_hi"),
        F.col("_c"),
    ).withColumn("_lo", F.col("_hi") - F.col("_c"))
    n = F.col("n")
    wanted = F.array_distinct(
        F.array(*[r for p in probs.values() for r in _ranks(p, n, rule)])
    )
    buckets = histogram.select(
        *keys,
        "_b",
        "n",
        "_lo",
        _ranks_inside(wanted).alias("_ranks"),
        "_c",
        "_from",
        "_to",
    ).where(F.size("_ranks") > 0)
    targets = settle(buckets, "quantile-buckets")
    wide = (F.col("_c") > most_rows) & (F.col("_from") < F.col("_to"))
    while not targets.where(wide).isEmpty():
        rest = targets.where(~wide)
        targets = settle(rest.unionByName(_narrowed(base, targets.where(wide).drop("_c"), keys)), "quantile-buckets")
    targets = targets.drop("_c")

    # A bucket's ranks go along as grouping columns; they are equal in all its rows.
    merged = (
        join_on(base, targets, [*keys, "_b"], "inner")
        .where(F.col("_v").between(F.col("_from"), F.col("_to")))
        .groupBy(*keys, "_b", "_from", "_v", "n", "_lo", "_ranks")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    inside = (
        Window.partitionBy(*keys, "_b", "_from")
        .orderBy("_v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    located = merged.withColumn("_hi", F.col("_lo") + F.sum("_c").over(inside))
    hits = located.select(
        *keys,
        "n",
        "_v",
        F.explode(
            F.filter(
                "_ranks",
                lambda r: (r >= F.col("_hi") - F.col("_c")) & (r < F.col("_hi")),
            )
        ).alias("_rank"),
    )
    # At most two hits per requested percentile reach this last grouping.
    found = hits.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"),
    )

    def pick(p: float) -> Column:
        places = _ranks(p, n, rule)
        low = F.try_element_at("_at", places[0])
        if rule == "index":
            return low
        high = F.try_element_at("_at", places[1])
        fraction = (n - 1) * F.lit(float(p)) - places[0]
        return low + (high - low) * fraction

    return found.select(*keys, "n", *[pick(p).alias(name) for name, p in probs.items()])
