"""Rules that decide which numbers can be trusted."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions.statistics import share
from tallywright.operators.keys import join_on

# Who is to blame for a terminal status.
FAILURE_CLASSES = {
    "Submitted": "model",
    "resolved": "model",
    "unresolved": "model",
    "empty_patch": "model",
    "LimitsExceeded": "agent-budget",
    "ContextWindowExceededError": "agent-budget",
    "Timeout": "infra",
    "InternalServerError": "infra",
    "RepeatedFormatError": "infra",
    "error": "harness",
}


def failure_class(status: Column, classes: Mapping[str, str] | None = None) -> Column:
    """Look a status up in a fixed table; an unlisted one is ``unknown``."""
    table = F.create_map(*[F.lit(x) for kv in (classes or FAILURE_CLASSES).items() for x in kv])
    return F.coalesce(F.try_element_at(table, status), F.lit("unknown"))


def classify_failures(
    verdicts: DataFrame, keys: Sequence[str], status: str,
    classes: Mapping[str, str] | None = None,
) -> DataFrame:
    """Items per failure class. The lookup is an expression, not a join."""
    return verdicts.groupBy(
        *keys, failure_class(F.col(status), classes).alias("failure_class")
    ).agg(F.count(F.lit(1)).alias("n"))


def zero_score_rule(
    scores: DataFrame, baseline: DataFrame, keys: Sequence[str], value: str = "score",
    floor: float = 0.5, collapse: float = 0.1,
) -> DataFrame:
    """Scores near zero where the known baseline is high point at the stack."""
    both = join_on(
        scores, baseline.select(*keys, F.col(value).alias("baseline")), keys, "left"
    )
    suspect = (F.col("baseline") >= floor) & (F.col(value) <= collapse * F.col("baseline"))
    return both.withColumn(
        "verdict",
        F.when(F.col("baseline").isNull(), "no baseline")
        .when(suspect, "infra failure")
        .otherwise("result"),
    )


def report_counts(instances: DataFrame, keys: Sequence[str], status: str = "status") -> DataFrame:
    """Grader-report counters recomputed from item rows.

    ``status`` is resolved, unresolved, empty_patch, error or incomplete.
    """
    def n(*names: str) -> Column:
        return F.count_if(F.col(status).isin(*names))

    return instances.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        n("resolved", "unresolved", "empty_patch", "error").alias("submitted"),
        n("resolved", "unresolved").alias("completed"),
        n("resolved").alias("resolved"),
        n("unresolved").alias("unresolved"),
        n("empty_patch").alias("empty_patch"),
        n("error").alias("error"),
        n("incomplete").alias("incomplete"),
    )


def conservation_checks(reports: DataFrame) -> DataFrame:
    """Counters of a report that must add up."""
    c = F.col
    return reports.withColumn(
        "submitted_ok", c("submitted") == c("completed") + c("empty_patch") + c("error")
    ).withColumn(
        "completed_ok", c("completed") == c("resolved") + c("unresolved")
    ).withColumn(
        "total_ok", c("total") == c("submitted") + c("incomplete")
    ).withColumn("conserved", c("submitted_ok") & c("completed_ok") & c("total_ok"))


def clean_run_gate(
    verdicts: DataFrame, keys: Sequence[str], harness_error: Column, has_verdict: Column,
    minimum: float = 0.9,
) -> DataFrame:
    """A run counts when the harness never failed and most items got a verdict."""
    return verdicts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(harness_error).alias("harness_errors"),
        share(has_verdict).alias("verdict_share"),
    ).withColumn(
        "clean", (F.col("harness_errors") == 0) & (F.col("verdict_share") >= minimum)
    )


def extractor_gate(agreement: DataFrame, limit: float = 0.05) -> DataFrame:
    """Runs whose score depends on which extractor reads the answer."""
    return agreement.withColumn("suspect", F.abs("score_gap") > limit)


def null_rate_gate(
    responses: DataFrame, keys: Sequence[str], limit: float = 0.1
) -> DataFrame:
    """Share of responses without content; a high one marks a budget-bound score."""
    return responses.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("content").isNull().cast("int")).alias("null_rate")
    ).withColumn("budget_bound", F.col("null_rate") > limit)


def provenance_check(claimed: DataFrame, catalogue: DataFrame, path: str = "path") -> DataFrame:
    """Claimed artefacts that the catalogue does not hold."""
    return join_on(claimed, catalogue.select(path), [path], "left_anti")


def level_pair_anomaly(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs whose instruction-level score is below the prompt-level one."""
    return scores.select(
        *keys,
        (F.col("inst_strict") < F.col("prompt_strict")).alias("strict_anomaly"),
        (F.col("inst_loose") < F.col("prompt_loose")).alias("loose_anomaly"),
    )
