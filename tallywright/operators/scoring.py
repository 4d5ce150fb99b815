"""Scores of responses and their uncertainty."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.functions import answers, statistics
from tallywright.operators.keys import join_on


def score_responses(
    responses: DataFrame,
    extractors: Mapping[str, Column] | None = None,
    ignore_punct: bool = True,
) -> DataFrame:
    """Add a prediction per extractor and whether it equals the gold answer.

    Narrow: one projection over the response scan. Columns are named
    ``pred_<extractor>`` and ``ok_<extractor>``.
    """
    content = answers.guard_null(F.col("content"))
    extractors = extractors or {
        "line": answers.extract_mcq(content),
        "fallback": answers.extract_mcq_fallback(content),
    }
    preds = responses.select(
        *responses.columns, *[e.alias(f"pred_{n}") for n, e in extractors.items()]
    )
    return preds.select(
        *preds.columns,
        *[
            answers.exact_match(F.col(f"pred_{n}"), F.col("gold"), ignore_punct=ignore_punct)
            .alias(f"ok_{n}")
            for n in extractors
        ],
    )


def score_summary(scored: DataFrame, keys: Sequence[str], correct: str) -> DataFrame:
    """n, mean and standard error of a 0/1 outcome per group."""
    hit = F.coalesce(F.col(correct).cast("int"), F.lit(0))
    grouped = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(hit).cast("bigint").alias("n_correct")
    )
    p = F.col("n_correct") / F.col("n")
    return grouped.select(
        *keys,
        "n",
        "n_correct",
        p.alias("score"),
        statistics.binomial_stderr(p, F.col("n")).alias("stderr"),
    )


def headline_scores(metrics: DataFrame, chosen: Mapping[str, tuple[str, str]]) -> DataFrame:
    """The metric and filter that stand for each benchmark, from the long table.

    ``chosen`` maps a benchmark to its (metric, filter); other rows and
    standard errors are left out. Reruns of one benchmark all stay: pick among
    them with ``run_ts`` or ``comparability_check`` before ranking.
    """
    table = F.create_map(
        *[x for task, (m, f) in chosen.items() for x in (F.lit(task), F.lit(f"{m},{f}"))]
    )
    key = F.concat_ws(",", "metric", "filter")
    return metrics.where(
        (F.try_element_at(table, F.col("task")) == key)
        & ~F.coalesce(F.col("is_stderr"), F.lit(False))
    )


def leaderboard(scores: DataFrame, tasks: Sequence[str], model: str = "system",
                task: str = "task", value: str = "score") -> DataFrame:
    """Model x benchmark table; a cell that was never measured stays null."""
    return scores.groupBy(model).pivot(task, list(tasks)).agg(F.max(value))


def sample_margins(scores: DataFrame, score: str = "score", n: str = "n") -> DataFrame:
    """Half-width of a subsample's score, and the band around it."""
    half = statistics.sample_margin(F.col(score), F.col(n))
    return scores.withColumn("margin", half).withColumn(
        "low", F.greatest(F.lit(0.0), F.col(score) - half)
    ).withColumn("high", F.least(F.lit(1.0), F.col(score) + half))


def filter_agreement(
    scored: DataFrame, keys: Sequence[str], first: str, second: str
) -> DataFrame:
    """How often two extractors agree, and what the choice does to the score."""
    a, b = F.col(f"pred_{first}"), F.col(f"pred_{second}")
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        statistics.share(a.eqNullSafe(b)).alias("agreement"),
        statistics.share(F.col(f"ok_{first}")).alias("score_first"),
        statistics.share(F.col(f"ok_{second}")).alias("score_second"),
        (
            statistics.share(F.col(f"ok_{first}")) - statistics.share(F.col(f"ok_{second}"))
        ).alias("score_gap"),
    )


def format_compliance(responses: DataFrame, keys: Sequence[str], pattern: str) -> DataFrame:
    """Share of responses that carry the required answer line."""
    return responses.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        statistics.share(F.col("content").rlike(pattern)).alias("compliant"),
    )


def instruction_scores(checks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Prompt-level and instruction-level accuracy, strict and loose.

    ``strict`` and ``loose`` are arrays of booleans, one entry per instruction.
    The flattened mean needs only the number of true entries and the length of
    each array, so nothing is exploded.
    """
    def trues(name: str) -> Column:
        return F.size(F.filter(name, lambda x: x))

    columns = [F.count(F.lit(1)).alias("n_prompts"),
               F.sum(F.size("strict")).cast("bigint").alias("n_instructions")]
    for name in ("strict", "loose"):
        columns += [
            statistics.share(F.forall(name, lambda x: x)).alias(f"prompt_{name}"),
            F.try_divide(F.sum(trues(name)), F.sum(F.size(name))).alias(f"inst_{name}"),
        ]
    return checks.groupBy(*keys).agg(*columns)


def truncation_curve(scored: DataFrame, keys: Sequence[str], correct: str,
                     finish_reason: str = "finish_reason") -> DataFrame:
    """Per budget: raw score, share cut off, and score on what was answered."""
    cut = F.col(finish_reason) == "length"
    hit = F.coalesce(F.col(correct).cast("int"), F.lit(0))
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~cut).alias("answered"),
        F.count_if(cut).alias("truncated"),
        F.avg(cut.cast("int")).alias("truncated_share"),
        F.avg(hit).alias("raw_score"),
        F.try_divide(F.sum(F.when(~cut, hit)), F.count_if(~cut)).alias("answered_score"),
    )


def partial_and_strict(df: DataFrame, keys: Sequence[str], credit: str) -> DataFrame:
    """Mean partial credit and the share of items with full credit."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(credit).alias("partial"),
        F.avg((F.col(credit) >= 1).cast("int")).alias("strict"),
    )


def bootstrap_ci(
    df: DataFrame,
    keys: Sequence[str],
    hits: str,
    trials: str,
    iterations: int = 1000,
    seed: int = 1234,
    level: float = 0.95,
    held: int = 1024,
) -> DataFrame:
    """Bootstrap interval of ``sum(hits) / sum(trials)``, resampling whole items.

    Items with equal ``(hits, trials)`` are interchangeable, and the number of
    times ``c`` such items are drawn is Poisson(c). So the items are first
    merged into counts (map-side). Draws are seeded from the
    outcome itself and so do not depend on how the data is partitioned.

    A task adds the draws of its outcomes up in two vectors per key, one element per iteration, and hands
    on the sums, so what is shuffled grows with keys and iterations and not with outcomes. It holds vectors of ``held`` keys
    at a time and hands on those it has before it begins with more.
    """
    keys = list(keys)
    outcomes = df.groupBy(*keys, hits, trials).agg(F.count(F.lit(1)).alias("_c"))
    seeded = outcomes.select(
        *keys, F.col(hits).cast("double").alias("_hits"), F.col(trials).cast("double").alias("_trials"), "_c",
        F.xxhash64(*keys, hits, trials, F.lit(seed)).alias("_seed"),
    )
    ends = ["_top", "_bottom"]
    vectors = T.StructType(
        [outcomes.schema[k] for k in keys] + [T.StructField(e, T.ArrayType(T.DoubleType())) for e in ends]
    )

    def sums_of_draws(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        fields: list[pa.Field] = []

        def handed_on() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in sums], f.type) for i, f in enumerate(fields)]
            columns += [pa.array([list(v[i]) for v in sums.values()], pa.list_(pa.float64())) for i in (0, 1)]
            return pa.RecordBatch.from_arrays(columns, names=keys + ends)

        for batch in batches:
            fields = [batch.schema.field(k) for k in keys]
            rows = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for *key, hit, trial, count, start in zip(*rows):
                if tuple(key) not in sums and len(sums) >= held:
                    yield handed_on()
                    sums.clear()
                mine = sums.setdefault(tuple(key), np.zeros((2, iterations)))
                drawn = np.random.default_rng(start & 0xFFFFFFFFFFFFFFFF).poisson(count, iterations)
                mine += np.outer([hit or 0.0, trial or 0.0], drawn)
        if sums:
            yield handed_on()

    drawn = seeded.mapInArrow(sums_of_draws, vectors).select(
        *keys, F.posexplode(F.arrays_zip(*ends)).alias("_i", "_sums")
    )
    replicates = drawn.groupBy(*keys, "_i").agg(
        F.try_divide(F.sum("_sums._top"), F.sum("_sums._bottom")).alias("_stat")
    )
    tail = (1 - level) / 2
    # One value per iteration: bounded by the parameter, whatever the data size.
    intervals = replicates.groupBy(*keys).agg(
        F.stddev_samp("_stat").alias("stderr"),
        F.percentile("_stat", F.lit(tail)).alias("low"),
        F.percentile("_stat", F.lit(1 - tail)).alias("high"),
    )
    point = outcomes.groupBy(*keys).agg(
        F.sum("_c").cast("bigint").alias("n"),
        F.try_divide(
            F.sum(F.col("_c") * F.col(hits)), F.sum(F.col("_c") * F.col(trials))
        ).alias("estimate"),
    )
    return join_on(point, intervals, keys, "inner")
