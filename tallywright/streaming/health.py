"""Wedged servers: the metadata endpoint answers while completions fail or hang.

Probes are summed up per host and short slot of time. Such summaries merge in any order, so a stream
writes those of each micro-batch and keeps no state; whoever reads them merges them and finds the stretches
between successful completions. A host has as many slots as its history is long, however chatty it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.operators.running import running
from tallywright.streaming.run import all_rows, drain


def probe_slots(
    probes: DataFrame, host: str, ts: str, metadata_ok: Column, completion_ok: Column,
    completion_failed: Column, seconds: int = 60,
) -> DataFrame:
    """Counts and first and last times per host and slot of ``seconds``; mergeable by :func:`merged_slots`."""
    slot = F.floor(F.unix_micros(ts) / (seconds * 1_000_000)).alias("slot")
    ok_at, failed_at = F.when(completion_ok, F.col(ts)), F.when(completion_failed, F.col(ts))
    return probes.where(F.col(host).isNotNull() & F.col(ts).isNotNull()).groupBy(F.col(host).alias("host"), slot).agg(
        F.count_if(completion_failed).alias("failures"),
        F.count_if(metadata_ok).alias("metadata_ok"),
        F.min(ok_at).alias("first_ok"),
        F.max(ok_at).alias("last_ok"),
        F.min(failed_at).alias("first_failure"),
        F.max(failed_at).alias("last_failure"),
    )


def merged_slots(slots: DataFrame) -> DataFrame:
    """Summaries of equal host and slot, from any number of batches, as one."""
    return slots.groupBy("host", "slot").agg(
        *[F.sum(c).alias(c) for c in ("failures", "metadata_ok")],
        *[F.min(c).alias(c) for c in ("first_ok", "first_failure")],
        *[F.max(c).alias(c) for c in ("last_ok", "last_failure")],
    )


def wedged_stretches(slots: DataFrame, minutes: int = 30) -> DataFrame:
    """Stretches without a successful completion that lasted at least ``minutes``.

    A stretch runs from one success (``after``) to the next (``until``), whatever windows it crosses; at
    an end of the history, where either is null, it runs to its own first or last failure. It is
    reported when completions failed in it and the metadata endpoint answered. Failures and answers of slots that also hold
    a success are counted on neither side, except that a failure after a slot's last success, or
    before its first, makes the stretch a failed one.
    """
    along = Window.partitionBy("host").orderBy("slot")
    good = F.col("last_ok").isNotNull()
    numbered = slots.withColumn(
        "_stretch", F.coalesce(F.sum(good.cast("bigint")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    # A slot with a success closes a stretch and opens the next one.
    closing = F.struct(
        F.col("_stretch").alias("stretch"), F.lit(None).cast("timestamp").alias("after"), F.col("first_ok").alias("until"),
        F.when(~good | (F.col("first_failure") < F.col("first_ok")), F.col("first_failure")).alias("first_failure"),
        F.when(~good, F.col("last_failure")).otherwise(F.when(F.col("first_failure") < F.col("first_ok"), F.col("first_failure"))).alias("last_failure"),
        F.when(good, 0).otherwise(F.col("failures")).alias("failures"),
        F.when(good, 0).otherwise(F.col("metadata_ok")).alias("metadata_ok"),
    )
    later = F.when(F.col("last_failure") > F.col("last_ok"), F.col("last_failure"))
    opening = F.struct(
        (F.col("_stretch") + 1).alias("stretch"), F.col("last_ok").alias("after"), F.lit(None).cast("timestamp").alias("until"),
        later.alias("first_failure"), later.alias("last_failure"),
        F.lit(0).cast("bigint").alias("failures"), F.lit(0).cast("bigint").alias("metadata_ok"),
    )
    sides = F.when(good, F.array(closing, opening)).otherwise(F.array(closing))
    out = numbered.select("host", F.explode(sides).alias("s")).select("host", "s.*").groupBy("host", "stretch").agg(
        F.max("after").alias("after"), F.min("until").alias("until"), F.min("first_failure").alias("first_failure"),
        F.max("last_failure").alias("last_failure"), F.sum("failures").cast("bigint").alias("failures"),
        F.sum("metadata_ok").cast("bigint").alias("metadata_ok"),
    )
    lasted = F.unix_micros(F.coalesce("until", "last_failure")) - F.unix_micros(F.coalesce("after", "first_failure"))
    return out.where(
        F.col("last_failure").isNotNull() & (F.col("metadata_ok") > 0) & (lasted >= minutes * 60_000_000)
    ).drop("stretch")


def wedge_detector(
    probes: DataFrame, host: str, ts: str, metadata_ok: Column, completion_ok: Column,
    completion_failed: Column, minutes: int = 30, slot_seconds: int = 60,
) -> DataFrame:
    """Stretches of at least ``minutes`` in which completions failed and none succeeded, from a stream or a table.

    Runs a stream over all its input. ``completion_failed`` says what counts as failed; a request that
    never answered is a row without a status, so let it include these. Results don't depend on the
    order or number of files, and no state is kept between batches.
    """

    def slots(rows: DataFrame) -> DataFrame:
        return probe_slots(rows, host, ts, metadata_ok, completion_ok, completion_failed, slot_seconds)

    if probes.isStreaming:
        out = drain(probes, "append", lambda batch, to: slots(batch).write.mode("overwrite").parquet(to))
        merged = merged_slots(all_rows(probes.sparkSession, out))
    else:
        merged = slots(probes)
    return wedged_stretches(merged, minutes).withColumnRenamed("host", host)


def wedge_stretches(
    probes: DataFrame, host: str, ts: str, order: Sequence[str], chunk: Column,
    metadata_ok: Column, completion_ok: Column, completion_failed: Column,
    minutes: int = 30,
) -> DataFrame:
    """Exact stretches between successful completions, for tables.

    Successes number the stretches by a running sum; a stretch is reported when
    its failures span the given time and the metadata endpoint answered in it.
    """
    flag = F.when(completion_ok, 1).otherwise(0).cast("bigint")
    stretched = running(probes, [host], order, chunk, sums={"_stretch": flag})
    failed_at = F.when(completion_failed, F.col(ts))
    out = stretched.groupBy(host, "_stretch").agg(
        F.min(failed_at).alias("wedged_from"),
        F.max(failed_at).alias("wedged_to"),
        F.count_if(completion_failed).alias("failures"),
        F.count_if(metadata_ok).alias("metadata_ok"),
    )
    span_s = (F.unix_micros("wedged_to") - F.unix_micros("wedged_from")) / 1e6
    return out.where((span_s >= minutes * 60) & (F.col("metadata_ok") > 0)).drop("_stretch")
