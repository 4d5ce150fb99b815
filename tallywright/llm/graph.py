"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.workspace import settle


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], int(row["h"] or 0)


def star_round(state: DataFrame) -> DataFrame:
    """Links (a, b), a > b, of the same components as those of ``state``, each node nearer to its smallest one.

    Large-star, then small-star; both are written to the shared folder.
    """
    both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = settle(
        both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(),
        "large-star",
    )
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return settle(low.select("a", F.col("m").alias("b")).unionByName(small).distinct(), "small-star")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node reachable.

    Links with a null end and loops are ignored; repeated links count once; no links give no rows.
    Each round links every node's neighbours to its smallest one: two aggregations with map-side
    combine and two joins that Spark may split, so a node with very many links is no hot group.
    Every round is written to the shared folder. A round after which nothing has changed ends it.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    state = settle(
        pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    mark = _mark(state)
    while mark[0]:
        state = star_round(state)
        before, mark = mark, _mark(state)
        if before == mark:
            break
    roots = state.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
