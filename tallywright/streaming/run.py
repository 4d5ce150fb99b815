"""Running a stream to the end of its input and reading what it produced."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.workspace import shared_dir


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet table, kept as one file or as a folder, as a stream."""
    # Written as a pattern, since the file source takes a single file only so.
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", 64)
        .parquet(f"{path[:-1]}[{path[-1]}]")
    )


def drain(
    stream: DataFrame,
    mode: str,
    write: Callable[[DataFrame, str], None] | None = None,
) -> str:
    """Process all available input; returns the folder the batches were written to.

    Each micro-batch goes to its own sub-folder, written with overwrite, so a
    batch that is replayed after a failure replaces itself.
    """
    spark = stream.sparkSession
    out, state = shared_dir(spark, "stream-out"), shared_dir(spark, "stream-state")

    def put(batch: DataFrame, batch_id: int) -> None:
        target = f"{out}/batch={batch_id}"
        if write is not None:
            write(batch, target)
        else:
            batch.write.mode("overwrite").parquet(target)

    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(put)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return out


def final_rows(spark: SparkSession, out: str) -> DataFrame:
    """What a complete-mode stream wrote last; a batch without input changes nothing."""
    rows = spark.read.parquet(out)
    last = rows.agg(F.max("batch")).first()[0]
    return rows.filter(F.col("batch") == last).drop("batch")


def all_rows(spark: SparkSession, out: str) -> DataFrame:
    """Everything an append-mode stream wrote."""
    return spark.read.parquet(out).drop("batch")


def latest_rows(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """The last version of each key an update-mode stream wrote."""
    rows = spark.read.parquet(out)
    payload = [c for c in rows.columns if c not in (*keys, "batch")]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*payload), "batch").alias("_last"))
        .select(*keys, *[F.col(f"_last.`{c}`").alias(c) for c in payload])
    )
