"""Comparing systems, claims and configurations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.operators.keys import join_on
from tallywright.operators.running import running
from tallywright.workspace import settle

# Fixed value: memory kept free for the runtime, in GB.
RUNTIME_RESERVE_GB = 5
# Bytes per parameter by weight format.
BYTES_PER_PARAM = {"NVFP4": 0.5, "MXFP4": 0.5, "INT4": 0.5, "FP8": 1.0, "INT8": 1.0,
                   "BF16": 2.0, "FP16": 2.0}


def rank_models(
    scores: DataFrame, task: str = "task", value: str = "score", tie: str = "system"
) -> DataFrame:
    """Rank per benchmark (ties share a rank) and a flag on the best."""
    w = Window.partitionBy(task).orderBy(F.col(value).desc_nulls_last())
    return scores.withColumn(
        "rank", F.when(F.col(value).isNotNull(), F.rank().over(w))
    ).withColumn("dense_rank", F.when(F.col(value).isNotNull(), F.dense_rank().over(w))
    ).withColumn("best", F.coalesce(F.col("rank") == 1, F.lit(False)))


def rank_inversion(
    scores: DataFrame, first: str, second: str, system: str = "system", task: str = "task",
    value: str = "score",
) -> DataFrame:
    """Rank change of each system between two task families."""
    wide = scores.where(F.col(task).isin(first, second)).groupBy(system).agg(
        F.max(F.when(F.col(task) == first, F.col(value))).alias("_a"),
        F.max(F.when(F.col(task) == second, F.col(value))).alias("_b"),
    ).where(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    # One row per system: the ranking window holds a leaderboard, not the data.
    everyone = Window.partitionBy(F.lit(1))
    ranked = wide.select(
        system,
        F.rank().over(everyone.orderBy(F.col("_a").desc())).alias("rank_first"),
        F.rank().over(everyone.orderBy(F.col("_b").desc())).alias("rank_second"),
    )
    return ranked.withColumn("rank_change", F.col("rank_second") - F.col("rank_first"))


def spearman(ranks: DataFrame, a: str = "rank_first", b: str = "rank_second") -> DataFrame:
    """Correlation of two rank columns."""
    return ranks.agg(
        F.count(F.lit(1)).alias("n_systems"),
        F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("spearman"),
    )


def vs_baseline(
    scores: DataFrame, reference: str, keys: Sequence[str], system: str = "system",
    value: str = "score",
) -> DataFrame:
    """Delta and ratio of every system to a reference system."""
    ref = scores.where(F.col(system) == reference).select(*keys, F.col(value).alias("reference"))
    own = scores.where(F.col(system) != reference).select(system, *keys, F.col(value).alias("value"))
    return join_on(own, ref, keys, "left").withColumn(
        "delta", F.col("value") - F.col("reference")
    ).withColumn("ratio", F.try_divide(F.col("value"), F.col("reference")))


def reconcile(
    claims: DataFrame, measured: DataFrame, keys: Sequence[str], value: str, tolerance: float
) -> DataFrame:
    """Published against recomputed values, with a reason where they part."""
    both = join_on(
        claims.select(*keys, F.col(value).alias("claimed")),
        measured.select(*keys, F.col(value).alias("measured")),
        keys,
        "full",
    )
    off = F.abs(F.col("claimed") - F.col("measured"))
    return both.withColumn(
        "status",
        F.when(F.col("claimed").isNull(), "not claimed")
        .when(F.col("measured").isNull(), "not measured")
        .when(off > tolerance, "differs")
        .otherwise("agrees"),
    )


def memory_need_gb(params_b: Column, quantisation: Column) -> Column:
    """GB a model needs: all parameters (also of a sparse model) plus the reserve."""
    table = F.create_map(*[F.lit(x) for kv in BYTES_PER_PARAM.items() for x in kv])
    return params_b * F.try_element_at(table, quantisation) + RUNTIME_RESERVE_GB


def fits_memory(
    models: DataFrame, hosts: DataFrame, need_gb: str, usable_gb: str
) -> DataFrame:
    """For each model: how many hosts it fits and the smallest memory that holds it.

    Distinct needs and hosts are put in one falling order of memory. A running count of hosts and the
    last host met answer each need, so no pair is formed and sizes are compared as they are; the answers are joined
    to the models, a join that Spark may split where very many need the same. A model without a need fits nowhere.
    """
    needs = models.where(F.col(need_gb).isNotNull()).groupBy(F.col(need_gb).alias("_need")).agg(F.lit(1).alias("_side"))
    asked = needs.withColumn("_x", -F.col("_need"))
    offered = hosts.where(F.col(usable_gb) >= 0).select((-F.col(usable_gb)).alias("_x"), F.lit(0).alias("_side"))
    host = F.col("_side") == 0
    placed = running(
        asked.unionByName(offered, allowMissingColumns=True), [], ["_x", "_side"], F.floor("_x"),
        sums={"n_hosts": F.when(host, 1).otherwise(0).cast("bigint")},
        carries={"smallest_fit_gb": F.when(host, -F.col("_x"))},
    )
    answers = settle(placed.where("_side = 1").select("_need", "n_hosts", "smallest_fit_gb"), "memory-answers")
    known = models.join(answers, F.col(need_gb) == F.col("_need"), "left").drop("_need")
    return known.withColumn("n_hosts", F.coalesce("n_hosts", F.lit(0).cast("bigint"))).withColumn("fits", F.col("n_hosts") > 0)


def run_configs(metrics: DataFrame, run: str = "file") -> DataFrame:
    """What a run's scores depend on, as one settings map per run and benchmark.

    Built from the long ``metrics`` table: task hash, output budget, harness
    version, the filters reported, the generation settings (temperature, stop words, number of
    examples and whatever else is given), and the client's arguments.
    """
    own = F.create_map(
        F.lit("task_hash"), "task_hash",
        F.lit("max_gen_toks"), F.col("max_gen_toks").cast("string"),
        F.lit("harness_version"), "harness_version",
        F.lit("filters"), "filters",
    )
    generation = F.coalesce("generation", F.create_map().cast("map<string,string>"))
    args = F.transform_keys(
        F.coalesce("model_args", F.create_map().cast("map<string,string>")),
        lambda k, v: F.concat(F.lit("args."), k),
    )
    # The rows of one run and benchmark repeat its settings: few, and equal.
    per_run = metrics.groupBy(run, "task").agg(
        *[F.any_value(c).alias(c) for c in ("task_hash", "max_gen_toks", "harness_version",
                                            "model_args", "generation")],
        F.array_join(F.array_sort(F.collect_set("filter")), ",").alias("filters"),
    )
    return per_run.select(
        run, "task", F.map_filter(F.map_concat(own, generation, args), lambda k, v: v.isNotNull()).alias("config")
    )


def comparability_check(
    configs: DataFrame, reference: str, system: str = "system", config: str = "config"
) -> DataFrame:
    """Settings in which a system's run differs from the reference run's.

    ``config`` is a map; a key only one side has counts as a difference.
    """
    # One run's settings, read as a scalar: more than one reference row is an error.
    ref = configs.where(F.col(system) == reference).select(config).scalar()
    both = configs.where(F.col(system) != reference).select(
        system, F.col(config).alias("_own"), ref.alias("_ref")
    )
    keys = both.select(
        system, "_own", "_ref",
        F.explode(F.array_union(F.map_keys("_own"), F.map_keys("_ref"))).alias("key"),
    )
    return keys.select(
        system,
        "key",
        F.try_element_at("_own", F.col("key")).alias("value"),
        F.try_element_at("_ref", F.col("key")).alias("reference"),
    ).where(~F.col("value").eqNullSafe(F.col("reference")))


def comparable_systems(
    configs: DataFrame, reference: str, system: str = "system", config: str = "config"
) -> DataFrame:
    """One row per system: number of differing settings and the verdict."""
    diff = comparability_check(configs, reference, system, config).groupBy(system).agg(
        F.count(F.lit(1)).alias("n_differences")
    )
    others = configs.where(F.col(system) != reference).select(system).distinct()
    return join_on(others, diff, [system], "left").select(
        system,
        F.coalesce("n_differences", F.lit(0)).cast("bigint").alias("n_differences"),
        F.col("n_differences").isNull().alias("comparable"),
    )


def config_diff(
    configs: DataFrame, run: str = "run", config: str = "config"
) -> DataFrame:
    """Settings that differ between runs: distinct values and runs without the key.

    :func:`config_values` says which values they are.
    """
    n_runs = configs.agg(F.countDistinct(run)).scalar()
    values = configs.select(run, F.explode(config).alias("key", "value"))
    per_key = values.groupBy("key").agg(
        F.countDistinct("value").alias("n_values"), F.countDistinct(run).alias("n_with_key")
    )
    return per_key.select(
        "key", "n_values", (n_runs - F.col("n_with_key")).alias("n_without_key")
    ).where((F.col("n_values") > 1) | (F.col("n_without_key") > 0))


def config_values(configs: DataFrame, run: str = "run", config: str = "config") -> DataFrame:
    """(key, value, n_runs) for every setting in which runs differ; the null value stands for runs without the key."""
    differing = settle(config_diff(configs, run, config), "differing-settings")
    values = configs.select(F.col(run).alias("_run"), F.explode(config).alias("key", "value"))
    held = join_on(values, differing.select("key"), ["key"], "left_semi")
    found = held.groupBy("key", "value").agg(F.countDistinct("_run").alias("n_runs"))
    absent = differing.where("n_without_key > 0").select(
        "key", F.lit(None).cast("string").alias("value"), F.col("n_without_key").alias("n_runs")
    )
    return found.unionByName(absent)


def missing_matrix(
    scores: DataFrame, tasks: Sequence[str], system: str = "system", task: str = "task",
    states: DataFrame | None = None,
) -> DataFrame:
    """Cells of the model x benchmark table that hold no score, and why.

    The expected cells come from the declared benchmark list, expanded per
    model, so there is no product of two tables. ``states`` may explain cells
    (``blocked``, ``excluded``); the rest are ``not measured``.
    """
    cells = scores.select(system).distinct().select(
        system, F.explode(F.array(*[F.lit(t) for t in tasks])).alias(task)
    )
    measured = scores.where(F.col("score").isNotNull()).select(system, task)
    gaps = join_on(cells, measured, [system, task], "left_anti")
    if states is None:
        return gaps.withColumn("state", F.lit("not measured"))
    known = join_on(gaps, states.select(system, task, "state"), [system, task], "left")
    return known.withColumn("state", F.coalesce("state", F.lit("not measured")))


def token_usage(requests: DataFrame, task: str, in_tok: str, out_tok: str) -> DataFrame:
    """Tokens per task and overall; ``is_total`` tells the total from requests without a task."""
    per_task = requests.groupBy(task).agg(
        F.sum(in_tok).cast("bigint").alias("_in"), F.sum(out_tok).cast("bigint").alias("_out"),
        F.count(F.lit(1)).alias("_n"),
    )
    out = per_task.rollup(task).agg(
        (F.grouping(task) == 1).alias("is_total"),
        F.sum("_n").cast("bigint").alias("requests"),
        F.sum("_in").cast("bigint").alias("in_tokens"),
        F.sum("_out").cast("bigint").alias("out_tokens"),
    )
    return out.withColumn("total_tokens", F.col("in_tokens") + F.col("out_tokens"))


def eval_cost(runs: DataFrame, keys: Sequence[str], seconds: str) -> DataFrame:
    """Seconds per item and hours of wall time."""
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("items"),
        F.avg(seconds).alias("seconds_per_item"),
        (F.sum(seconds) / 3600).alias("hours"),
    )
