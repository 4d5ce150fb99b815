"""Verdicts that arrive over time: progress, new results, late segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.operators.bloom import bloom_words, maybe_in
from tallywright.operators.keys import join_on
from tallywright.sources.agentic import FRAME_COUNT, parse_progress
from tallywright.streaming.run import all_rows, drain
from tallywright.workspace import settle


def progress_source(spark: SparkSession, folder: str) -> DataFrame:
    """Progress logs as a stream of frames; carriage returns end frames.

    Logs are many and small, and a micro-batch costs the driver the same for few as for many, so it takes bytes, not files.
    """
    lines = spark.readStream.option("recursiveFileLookup", "true").option(
        "maxBytesPerTrigger", 256 << 20
    ).text(folder)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def progress_stream(frames: DataFrame, run: Column) -> DataFrame:
    """Latest counters per run. Counters only grow, so the maximum is the latest.

    State is one row of counters per run.
    """
    parsed = parse_progress(frames.where(F.col("text").rlike(FRAME_COUNT)), run)
    return parsed.groupBy("run").agg(
        *[F.max(c).alias(c) for c in ("done", "total", "ok", "bad", "error", "elapsed_s")]
    )


def ingest_results(
    results: DataFrame, keys: Sequence[str], ts: str, watermark: str | None = None
) -> DataFrame:
    """New result rows, each key once.

    The state holds every key, so that no row is late; a watermark bounds it to recent
    keys, for streams whose rows come in order of time. :func:`ingest_archive` needs neither.
    """
    if not watermark:
        return results.dropDuplicates(list(keys))
    return results.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(keys))


def ingest_archive(results: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """New result rows of a stream, each key once, with nothing kept in executors between batches.

    What was accepted is the store: a folder per micro-batch. A batch keeps of each of its keys the row that
    comes first in ``order`` and takes away the keys of earlier folders. Of the store only key columns are
    read, and a Bloom filter of the batch's keys, of fixed size, leaves of them little more than those the batch
    repeats, so the exact anti-join shuffles no more than the batch. A batch that is replayed looks at earlier folders only and
    replaces its own. Null keys equal each other. Which row of a key stays depends on the batches, not the keys.
    """
    keys, columns = list(keys), results.columns
    position = F.struct(*order)

    def write(batch: DataFrame, target: str) -> None:
        store, number = target.rsplit("/batch=", 1)
        fresh = batch.groupBy(*keys).agg(F.min_by(F.struct(*columns), position).alias("_r")).select("_r.*")
        if int(number):
            fresh = settle(fresh, "fresh-results")
            known = T.StructType([fresh.schema[k] for k in keys] + [T.StructField("batch", T.IntegerType())])
            seen = fresh.sparkSession.read.schema(known).parquet(store).where(F.col("batch") < int(number))
            words = bloom_words(fresh, F.xxhash64(*keys))
            fresh = join_on(fresh, maybe_in(seen.select(*keys), F.xxhash64(*keys), words), keys, "left_anti")
        fresh.write.mode("overwrite").parquet(target)

    return all_rows(results.sparkSession, drain(results, "append", write)).select(*columns)


def late_segments(
    attempts: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str]
) -> DataFrame:
    """Last-status-wins verdicts of a stream whose segments arrive late.

    The stream itself is stateless. Each micro-batch is reduced to one row per
    item it touches and written to its own folder; merging those rows by the
    attempt's position, not by arrival, gives the verdicts. So a segment may be
    any amount late, nothing has to be kept in memory for it, and a replayed
    batch replaces its own rows.
    """
    position = F.struct(*order)

    def write(batch: DataFrame, target: str) -> None:
        batch.groupBy(*keys).agg(
            F.max(position).alias("_at"),
            F.max_by(F.struct(*keep), position).alias("_last"),
            F.count(F.lit(1)).alias("_n"),
        ).write.mode("overwrite").parquet(target)

    touched = attempts.sparkSession.read.parquet(drain(attempts, "append", write))
    return (
        touched.groupBy(*keys)
        .agg(F.max_by("_last", "_at").alias("_last"), F.sum("_n").alias("n_attempts"))
        .select(*keys, *[F.col(f"_last.`{c}`").alias(c) for c in keep], "n_attempts")
    )
