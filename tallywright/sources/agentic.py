"""Readers of agentic-run artefacts: grader reports, exit statuses and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright import schemas
from tallywright.functions import parsing
from tallywright.operators.running import running
from tallywright.sources.files import LINE_ORDER, model_of, read_documents, read_lines, run_of

# Formats of the logs.
STATUS_ROOT = "^instances_by_exit_status:"
STATUS_KEY = r"^\s+([A-Za-z_]+):\s*$"
STATUS_ITEM = r"^\s*- (\S+)\s*$"
LOG_MODEL = r"^==== \S+ \((\S+)\) START"
LOG_TITLE = r"^\[P[0-9]+\] (.*)$"
PROBLEM = r"^\[?P([0-9]+)(?:\]|:)"
OUTCOME = r"^P[0-9]+: (PASS|FAIL)"
ROUND = r"round ([0-9]+) ->"
GREEN = r"(?:green in|verifier in|PASS in) ([0-9]+)"
CANDIDATE = r"cand_([0-9]+)"
SCORE = r"(?:score=|@ |-> |^P[0-9]+: PASS )([0-9]+(?:\.[0-9]+)?)(?:\s|$)"
UNIT = r"[0-9.]+ ([A-Za-z]+/s)"
VERDICT = r"verdict=(.*?) ?score="
FRAME_COUNT = r"([0-9]+)/([0-9]+) \["
FRAME_CLOCK = r"\[([0-9:]+)<"
STATUSES = ("resolved", "unresolved", "empty_patch", "error", "incomplete")
COUNTERS = ("total", "submitted", "completed", "resolved", "unresolved", "empty_patch", "error")


def _found(pattern: str, group: int = 1, mark: str = "") -> Column:
    """What ``pattern`` finds; ``mark`` is a text that every match holds, a cheap test for lines without one."""
    text = F.when(F.col("text").contains(mark), F.col("text")) if mark else F.col("text")
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _reports(spark: SparkSession, path: str) -> DataFrame:
    return read_documents(spark, path).select(
        model_of(F.col("file")).alias("model"),
        run_of(F.col("file")).alias("run"),
        F.from_json("text", schemas.GRADER_REPORT).alias("d"),
    )


def read_swe_report(spark: SparkSession, path: str) -> DataFrame:
    """Grader reports -> one row per item and its status."""

    def tagged(status: str) -> Column:
        return F.transform(
            F.coalesce(F.col(f"d.{status}_ids"), F.array().cast("array<string>")),
            lambda i: F.struct(i.alias("instance_id"), F.lit(status).alias("status")),
        )

    return _reports(spark, path).select(
        "model", "run", F.explode(F.concat(*[tagged(s) for s in STATUSES])).alias("i")
    ).select("model", "run", "i.*")


def read_swe_counts(spark: SparkSession, path: str) -> DataFrame:
    """Counters of grader reports, as stated in the files."""
    return _reports(spark, path).select(
        "model",
        "run",
        *[F.col(f"d.{c}_instances").alias(c) for c in COUNTERS],
        F.size("d.incomplete_ids").cast("bigint").alias("incomplete"),
    )


def read_exit_status(spark: SparkSession, path: str) -> DataFrame:
    """Exit-status files whose root key repeats, one segment per repetition."""
    lines = read_lines(spark, path).select(
        "file",
        *LINE_ORDER,
        (F.col("text").contains("instances_by") & F.col("text").rlike(STATUS_ROOT)).alias("is_root"),
        _found(STATUS_KEY, mark=":").alias("status_key"),
        _found(STATUS_ITEM, mark="- ").alias("instance_id"),
    )
    root = F.when(F.col("is_root"), 1).otherwise(0).cast("bigint")
    placed = running(
        lines, ["file"], LINE_ORDER, F.col("block"),
        sums={"segment": root}, carries={"status": F.col("status_key")},
    )
    return placed.where(F.col("instance_id").isNotNull()).select(
        run_of(F.col("file")).alias("run"),
        F.col("segment").cast("int").alias("segment"),
        "status",
        "instance_id",
        "file",
    )


def read_agent_log(spark: SparkSession, path: str) -> DataFrame:
    """Problem logs -> events: outcomes, rounds, candidates and measurements."""
    text = F.col("text")
    lines = read_lines(spark, path).select(
        "file", *LINE_ORDER, "text", _found(LOG_MODEL, mark="==== ").alias("_model"), _found(PROBLEM).alias("_problem")
    )
    placed = running(
        lines, ["file"], LINE_ORDER, F.col("block"), carries={"model": F.col("_model")}
    ).where(F.col("_problem").isNotNull())
    champion = text.contains("champion=")
    outcome = _found(OUTCOME)
    green = text.contains(" in ") & text.rlike(GREEN)
    return placed.select(
        F.coalesce("model", model_of(F.col("file"))).alias("model"),
        F.col("_problem").cast("int").alias("problem"),
        _found(LOG_TITLE, mark="[P").alias("title"),
        F.when(text.startswith("[P") & text.rlike(LOG_TITLE), "title")
        .when(outcome.isNotNull(), F.lower(outcome))
        .when(text.contains("round ") & text.rlike(ROUND), "round")
        .when(text.contains("cand_") & text.rlike(CANDIDATE), "candidate")
        .otherwise("note")
        .alias("event"),
        F.coalesce(_found(ROUND, mark="round "), _found(GREEN, mark=" in ")).try_cast("int").alias("round"),
        _found(CANDIDATE, mark="cand_").try_cast("int").alias("candidate"),
        F.when(~green, _found(SCORE)).try_cast("double").alias("score"),
        _found(UNIT, mark="/s").alias("unit"),
        parsing.normalise_verdict(_found(VERDICT, mark="verdict=")).alias("verdict"),
        champion.alias("is_champion"),
        _found(r"^P[0-9]+: (.*)$").alias("detail"),
        "file",
    )


def read_progress_log(spark: SparkSession, path: str) -> DataFrame:
    """Progress frames -> counters; ``seq`` is the frame's place in its file."""
    frames = read_lines(spark, path).where(F.col("text").rlike(FRAME_COUNT)).select(
        "file", *LINE_ORDER, "text"
    )
    placed = running(
        frames, ["file"], LINE_ORDER, F.col("block"), sums={"seq": F.lit(1).cast("bigint")}
    )
    return parse_progress(placed, run_of(F.col("file")), "seq", "file")


def parse_progress(frames: DataFrame, run: Column, *keep: str) -> DataFrame:
    """Counters of progress frames in column ``text``; also used by the stream."""
    def count(mark: str) -> Column:
        return _found(mark + r"=([0-9]+)").try_cast("int")

    return frames.select(
        run.alias("run"),
        *[k for k in keep if k == "seq"],
        _found(FRAME_COUNT).try_cast("int").alias("done"),
        _found(FRAME_COUNT, 2).try_cast("int").alias("total"),
        count("✓").alias("ok"),
        count("✖").alias("bad"),
        count("error").alias("error"),
        parsing.parse_duration(_found(FRAME_CLOCK)).cast("int").alias("elapsed_s"),
        *[k for k in keep if k != "seq"],
    )
