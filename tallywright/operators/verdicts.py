"""Pass/fail verdicts of items attempted by several systems.

Items reach their final status with ``max_by`` rather than a row-number
window: the aggregate combines on the map side and shuffles one row per item.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.operators.keys import join_on


def union_segments(*parts: tuple[str, DataFrame]) -> DataFrame:
    """Stack resumed parts of a run, keeping which part a row came from."""
    out: DataFrame | None = None
    for name, part in parts:
        tagged = part.withColumn("segment", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no segments given")
    return out


def last_status_wins(
    attempts: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str]
) -> DataFrame:
    """One verdict per item: the latest attempt's columns, and how many there were."""
    latest = F.max_by(F.struct(*keep), F.struct(*order)).alias("_last")
    return (
        attempts.groupBy(*keys)
        .agg(latest, F.count(F.lit(1)).alias("n_attempts"))
        .select(*keys, *[F.col(f"_last.`{c}`").alias(c) for c in keep], "n_attempts")
    )


def distinct_instances(attempts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each item once, however many segments list it."""
    return attempts.select(*keys).dropDuplicates(list(keys))


def merge_reruns(
    base: DataFrame, replay: DataFrame, keys: Sequence[str], keep: Sequence[str]
) -> DataFrame:
    """Replay overrides base where it has the item; ``source`` tells which won.

    Items the base run never had are not added. One shuffle of both sides.
    """
    stacked = base.select(*keys, *keep, F.lit(0).alias("_src")).unionByName(
        replay.select(*keys, *keep, F.lit(1).alias("_src"))
    )
    return (
        stacked.groupBy(*keys)
        .agg(
            F.max_by(F.struct(*keep), "_src").alias("_won"),
            F.max("_src").alias("_src"),
            F.min("_src").alias("_first"),
        )
        .where(F.col("_first") == 0)
        .select(
            *keys,
            *[F.col(f"_won.`{c}`").alias(c) for c in keep],
            F.when(F.col("_src") == 1, "replay").otherwise("base").alias("source"),
        )
    )


def rerun_worklist(items: DataFrame, responses: DataFrame, keys: Sequence[str],
                   denied: Column) -> DataFrame:
    """Items whose response was cut off or denied a verdict."""
    return join_on(items, responses.where(denied).select(*keys), keys, "left_semi",
                   null_safe=False)


def resume_worklist(items: DataFrame, completed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items with no completed attempt yet."""
    return join_on(items, completed.select(*keys), keys, "left_anti", null_safe=False)


def resolve_by_repo(
    verdicts: DataFrame, resolved: str, repo: str = "repo", by: Sequence[str] = ()
) -> DataFrame:
    """Resolved and attempted per stratum, with a total row per group."""
    counted = verdicts.groupBy(*by, repo).agg(
        F.count_if(F.col(resolved)).alias("resolved"), F.count(F.lit(1)).alias("attempted")
    )
    # The strata table is small; the total row is added on top of it.
    with_total = counted.select(
        *by,
        F.explode(F.array(F.col(repo), F.lit("TOTAL"))).alias(repo),
        "resolved",
        "attempted",
    )
    summed = with_total.groupBy(*by, repo).agg(
        F.sum("resolved").cast("bigint").alias("resolved"),
        F.sum("attempted").cast("bigint").alias("attempted"),
    )
    return summed.withColumn("rate", F.try_divide(F.col("resolved"), F.col("attempted")))


def status_counts(
    verdicts: DataFrame, keys: Sequence[str], status: str, statuses: Sequence[str]
) -> DataFrame:
    """Items per terminal status, one column per status; absent ones are 0."""
    counts = [
        F.count_if(F.col(status).eqNullSafe(F.lit(s))).alias(f"n_{s.lower()}") for s in statuses
    ]
    known = F.col(status).isin(list(statuses))
    other = F.count_if(F.coalesce(~known, F.lit(True))).alias("n_other")
    return verdicts.groupBy(*keys).agg(*counts, other)


def coverage(verdicts: DataFrame, keys: Sequence[str], repo: str, instance: str) -> DataFrame:
    """Strata and items a run covers and how much its largest stratum weighs."""
    per_repo = verdicts.select(*keys, repo, instance).distinct().groupBy(*keys, repo).agg(
        F.count(F.lit(1)).alias("_n")
    )
    return per_repo.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_repos"),
        F.sum("_n").cast("bigint").alias("n_instances"),
        (F.max("_n") / F.sum("_n")).alias("largest_share"),
    )


def pass_count(verdicts: DataFrame, keys: Sequence[str], passed: str) -> DataFrame:
    """``k/N passed`` per group. Use ``failures`` for the failing items as rows."""
    out = verdicts.groupBy(*keys).agg(
        F.count_if(F.col(passed)).alias("passed"), F.count(F.lit(1)).alias("total")
    )
    return out.withColumn(
        "label", F.concat(F.col("passed").cast("string"), F.lit("/"),
                          F.col("total").cast("string"), F.lit(" passed"))
    )


def failures(verdicts: DataFrame, keys: Sequence[str], passed: str) -> DataFrame:
    """The failing items, one row each: a list may be as long as the data."""
    return verdicts.where(~F.coalesce(F.col(passed), F.lit(False))).select(*keys)


def head_to_head(
    verdicts: DataFrame, reference: str, system: str, instance: str, resolved: str
) -> DataFrame:
    """Every system against one reference on the items both attempted.

    Verdicts hold one row per (system, item), so the item join is one to one
    for each opponent and never multiplies rows.
    """
    ok = F.coalesce(F.col(resolved), F.lit(False))
    ref = verdicts.where(F.col(system) == reference).select(instance, ok.alias("_ref"))
    others = verdicts.where(F.col(system) != reference).select(system, instance, ok.alias("_own"))
    own, base = F.col("_own"), F.col("_ref")
    return join_on(others, ref, [instance], "inner", null_safe=False).groupBy(system).agg(
        F.count(F.lit(1)).alias("shared"),
        F.count_if(own & base).alias("both"),
        F.count_if(own & ~base).alias("system_only"),
        F.count_if(~own & base).alias("reference_only"),
        F.count_if(~own & ~base).alias("neither"),
    )


def failure_overlap(
    verdicts: DataFrame, system: str, instance: str, resolved: str
) -> DataFrame:
    """Number of items per set of systems that failed them.

    A set holds at most one entry per system, so it stays as small as the
    leaderboard is long.
    """
    failed = verdicts.where(~F.coalesce(F.col(resolved), F.lit(False)))
    return (
        failed.groupBy(instance)
        .agg(F.array_join(F.array_sort(F.collect_set(system)), ",").alias("failed_by"))
        .groupBy("failed_by")
        .agg(F.count(F.lit(1)).alias("n_instances"))
    )


def _sides(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    both = a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    return both.groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))


def same_sample(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether two runs cover the identical set, and what only one of them has."""
    sides = _sides(a, b, keys)
    only_a = F.count_if((F.col("_a") == 1) & (F.col("_b") == 0))
    only_b = F.count_if((F.col("_a") == 0) & (F.col("_b") == 1))
    return sides.agg(
        F.count_if((F.col("_a") == 1) & (F.col("_b") == 1)).alias("shared"),
        only_a.alias("only_a"),
        only_b.alias("only_b"),
    ).withColumn("identical", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def shared_instances(
    verdicts: DataFrame, a: str, b: str, system: str, instance: str, resolved: str
) -> DataFrame:
    """Scores of two systems on the items both attempted."""
    pair = verdicts.where(F.col(system).isin(a, b))
    ok = F.coalesce(F.col(resolved), F.lit(False))

    def of(name: str) -> list[Column]:
        own = F.col(system) == name
        return [F.max(own.cast("int")), F.max((own & ok).cast("int"))]

    per_item = pair.groupBy(instance).agg(
        of(a)[0].alias("_has_a"), of(a)[1].alias("_ok_a"),
        of(b)[0].alias("_has_b"), of(b)[1].alias("_ok_b"),
    )
    return per_item.where((F.col("_has_a") == 1) & (F.col("_has_b") == 1)).agg(
        F.count(F.lit(1)).alias("n_shared"),
        F.sum("_ok_a").cast("bigint").alias("resolved_a"),
        F.sum("_ok_b").cast("bigint").alias("resolved_b"),
    )
