"""Readers of throughput sweeps: per-level JSON, CSV and three log dialects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright import schemas
from tallywright.operators.running import running
from tallywright.sources.files import LINE_ORDER, model_of, read_lines

# Header formats of the sweep logs.
HEADER = r"^=== concurrency=([0-9]+) num_prompts=([0-9]+)"
BANNER = r"^=+ CONCURRENCY ([0-9]+) =+"
RUNNING_BEFORE = r"engine_running_before=([0-9.]+)"
CLOCK = r"([0-9]{2}:[0-9]{2}:[0-9]{2}) ===$"
PROMPTS = r"num_prompts=([0-9]+)"
METRIC_LINE = r"^([A-Z][^:]*?):\s+([0-9.]+)\s*$"


def read_bench_json(spark: SparkSession, path: str) -> DataFrame:
    """Per-level benchmark JSON -> ``levels``."""
    raw = spark.read.option("recursiveFileLookup", "true").schema(schemas.BENCH_LEVEL).json(path)
    return raw.withColumnsRenamed(schemas.BENCH_RENAMES)


def read_sweep_csv(spark: SparkSession, path: str) -> DataFrame:
    """Sweep CSV -> ``levels``; the model comes from the path."""
    raw = (
        spark.read.option("recursiveFileLookup", "true")
        .schema(schemas.SWEEP_CSV)
        .csv(path, header=True)
    )
    return raw.select(model_of(F.col("_metadata.file_path")).alias("model"), *raw.columns)


def _found(pattern: str) -> Column:
    return F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))


def parse_sweep_lines(lines: DataFrame) -> DataFrame:
    """Log lines -> ``levels``: every header opens a level, metric lines fill it."""
    header = F.coalesce(_found(HEADER), _found(BANNER)).try_cast("int")
    useful = lines.select(
        "file",
        *LINE_ORDER,
        header.alias("concurrency"),
        _found(PROMPTS).try_cast("int").alias("num_prompts"),
        _found(RUNNING_BEFORE).try_cast("double").alias("engine_running_before"),
        _found(CLOCK).alias("level_ts"),
        _found(METRIC_LINE).alias("label"),
        F.regexp_extract("text", METRIC_LINE, 2).try_cast("double").alias("value"),
    )
    opened = F.when(F.col("concurrency").isNotNull(), 1).otherwise(0).cast("bigint")
    numbered = running(
        useful, ["file"], LINE_ORDER, F.col("block"), sums={"_level": opened}
    ).where(F.col("_level") > 0)
    filled = numbered.groupBy("file", "_level").agg(
        *[F.max(c).alias(c) for c in ("concurrency", "num_prompts", "engine_running_before",
                                      "level_ts")],
        *[
            F.max(F.when(F.col("label") == label, F.col("value"))).alias(name)
            for label, name in schemas.SWEEP_LABELS.items()
        ],
    )
    return filled.select(
        model_of(F.col("file")).alias("model"),
        *[c for c in filled.columns if c not in ("file", "_level")],
        "file",
    )


def read_sweep_log(spark: SparkSession, path: str) -> DataFrame:
    """Sweep logs of any dialect -> ``levels``."""
    return parse_sweep_lines(read_lines(spark, path))
