"""Live server metrics: counter rates, idle windows, sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.operators.running import running
from tallywright.streaming.run import all_rows, drain
from tallywright.workspace import settle


def timed(samples: DataFrame, ts: str, watermark: str | None) -> DataFrame:
    """The stream with a watermark, if one is wanted.

    An archive is read in no order of time, so a watermark would drop the rows of every file that is
    read after a newer one. Without it the state has a row per result, and late rows still count.
    """
    return samples.withWatermark(ts, watermark) if samples.isStreaming and watermark else samples


def counter_rate(
    samples: DataFrame, keys: Sequence[str], ts: str = "ts", value: str = "value",
    width: str = "1 hour", watermark: str | None = None,
) -> DataFrame:
    """Growth of a monotonic counter per tumbling window, reset-aware.

    A counter that never restarts has its first value as minimum and its last
    as maximum; anything else is a reset to zero. With one reset the growth is
    what was counted up to the peak plus what was counted after it. A restart
    that climbs past the old peak within one window leaves only the last value
    as a lower bound, so windows should be short against the time between
    restarts. Works on streams and on tables alike.
    """
    rows = timed(samples, ts, watermark)
    grouped = rows.groupBy(*keys, F.window(ts, width).alias("w")).agg(
        F.min_by(value, ts).alias("_first"),
        F.max_by(value, ts).alias("_last"),
        F.min(value).alias("_min"),
        F.max(value).alias("_max"),
        F.count(F.lit(1)).alias("samples"),
        F.min(ts).alias("_from"),
        F.max(ts).alias("_to"),
    )
    first, last = F.col("_first"), F.col("_last")
    growth = (
        F.when(F.col("_max") > last, F.col("_max") - first + last)
        .when(F.col("_min") < first, last)
        .otherwise(last - first)
    )
    seconds = (F.unix_micros("_to") - F.unix_micros("_from")) / 1e6
    return grouped.select(
        *keys,
        F.col("w.start").alias("window_start"),
        "samples",
        growth.alias("growth"),
        F.try_divide(growth, seconds).alias("rate"),
    )


def idle_gate(
    samples: DataFrame, keys: Sequence[str], busy: Column, ts: str = "ts",
    width: str = "2 hours", slide: str = "1 hour", watermark: str | None = None,
) -> DataFrame:
    """Sliding windows in which nothing ran or waited."""
    rows = timed(samples, ts, watermark)
    return (
        rows.groupBy(*keys, F.window(ts, width, slide).alias("w"))
        .agg(F.max(busy).alias("busiest"), F.count(F.lit(1)).alias("samples"))
        .select(
            *keys,
            F.col("w.start").alias("window_start"),
            "samples",
            (F.col("busiest") == 0).alias("idle"),
        )
    )


def instant_vs_sustained(
    rates: DataFrame, sustained: DataFrame, keys: Sequence[str], rate: str = "rate",
    limit: str = "sustained_rate",
) -> DataFrame:
    """Flag momentary rates above what the completed run sustained.

    ``rates`` may be a stream; ``sustained`` is a table with one row per key.
    """
    joined = rates.join(sustained, list(keys), "inner")
    return joined.withColumn(
        "overstated", F.coalesce(F.col(rate) > F.col(limit), F.lit(False))
    )


def run_sessions(
    activity: DataFrame, keys: Sequence[str], ts: str = "ts", gap: str = "1 day",
    watermark: str | None = None,
) -> DataFrame:
    """Group activity into runs separated by a gap of inactivity.

    For live streams: with a watermark a run is put out once it has ended. Archives, whose rows come in
    no order of time, are read by :func:`archive_sessions`.
    """
    rows = timed(activity, ts, watermark)
    return (
        rows.groupBy(*keys, F.session_window(ts, gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("events"))
        .select(
            *keys,
            F.col("w.start").alias("run_start"),
            F.col("w.end").alias("run_end"),
            "events",
        )
    )


def _gap_micros(gap: str) -> Column:
    return F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {gap}"))


def activity_slots(activity: DataFrame, keys: Sequence[str], ts: str, gap: str) -> DataFrame:
    """First and last time and number of rows per key and slot of one gap's length.

    Rows of one slot are less than a gap apart and so of one run. Summaries merge in any order, and a key has
    as many as its history has gaps, however many rows it has. Rows without a time belong to no run.
    """
    at = F.unix_micros(ts)
    return activity.where(F.col(ts).isNotNull()).groupBy(*keys, (at - F.pmod(at, _gap_micros(gap))).alias("_slot")).agg(
        F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.count(F.lit(1)).alias("_n")
    )


def joined_slots(slots: DataFrame, keys: Sequence[str], gap: str) -> DataFrame:
    """Runs from slots: one that begins a gap or more after the end of the one before opens a run."""
    merged = settle(
        slots.groupBy(*keys, "_slot").agg(
            F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.sum("_n").alias("_n")
        ),
        "activity-slots",
    )
    chunk = F.floor(F.col("_slot") / (_gap_micros(gap) * 65536))
    seen = running(merged, keys, ["_slot"], chunk, previous={"_before": F.col("_last")})
    apart = F.unix_micros("_first") - F.unix_micros("_before")
    opens = F.coalesce(apart >= _gap_micros(gap), F.lit(True)).cast("bigint")
    numbered = running(settle(seen, "activity-gaps"), keys, ["_slot"], chunk, sums={"_run": opens})
    return numbered.groupBy(*keys, "_run").agg(
        F.min("_first").alias("run_start"),
        F.timestamp_micros(F.unix_micros(F.max("_last")) + _gap_micros(gap)).alias("run_end"),
        F.sum("_n").alias("events"),
    ).drop("_run")


def archive_sessions(
    activity: DataFrame, keys: Sequence[str], ts: str = "ts", gap: str = "1 day"
) -> DataFrame:
    """Runs of a stream read to the end of its input, or of a table, in any order and number of files.

    Each micro-batch writes its slots; the reader merges them and joins those nearer than the gap. No state
    is kept between batches, what is written grows with the input alone, and no task gets all rows of a
    key. The last run of a key counts as ended.
    """
    if not activity.isStreaming:
        return joined_slots(activity_slots(activity, keys, ts, gap), keys, gap)

    def write(batch: DataFrame, target: str) -> None:
        activity_slots(batch, keys, ts, gap).write.mode("overwrite").parquet(target)

    out = drain(activity.select(*keys, ts), "append", write)
    return joined_slots(all_rows(activity.sparkSession, out), keys, gap)


def table_sessions(
    activity: DataFrame, keys: Sequence[str], ts: str = "ts", gap_seconds: int = 86400
) -> DataFrame:
    """``archive_sessions`` of a table, with the gap in seconds."""
    return archive_sessions(activity, keys, ts, f"{gap_seconds} seconds")
