"""Running values over long ordered groups.

A plain window over ``PARTITION BY key`` puts a whole key into one task. Here
each key is cut along its order into chunks. A small table of chunk totals says
what came before each chunk; its rows are put in front of their chunks as
opening rows, and one window per ``(key, chunk)`` then yields the same values
as the plain window would. A key that holds a third of all rows is spread over
as many tasks as it has chunks, and the rows are shuffled once.

Chunks are counted. If one holds more rows than a task should order, as when
most rows fall into one second, the rows are cut anew into ranges of about
equal numbers along keys and order, whatever they are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.workspace import settle

# Rows of a chunk, about; ranges are cut to half of it, as their bounds are sampled.
MOST_ROWS = 1 << 21
# Rows a task orders, about; their chunks are whole, so one may have up to MOST_ROWS more.
TASK_ROWS = 1 << 18

CHUNK = "_chunk"
IS_ROW = "_is_row"


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    sums: Mapping[str, Column] | None = None,
    carries: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None,
    most_rows: int = MOST_ROWS,
) -> DataFrame:
    """Add running values in ``order`` within ``keys``.

    ``sums`` are running sums, ``carries`` the last non-null value up to and
    including the row, ``previous`` the last non-null value before the row.

    ``chunk`` must never decrease along ``order`` (a time bucket, a block of
    line numbers). Rows that tie in ``order`` follow each other in no fixed
    order, so it should be unique within ``keys`` unless that does not matter: only rows that
    tie stay together however many they are. No chunk of others has many more than ``most_rows``.
    """
    sums, carries, previous = dict(sums or {}), dict(carries or {}), dict(previous or {})
    lasts = {**carries, **previous}
    names = [*sums, *lasts]
    rows = df.withColumn(CHUNK, chunk)
    position = F.struct(*[F.col(c) for c in order])

    def counted(rows: DataFrame) -> DataFrame:
        per_chunk = rows.groupBy(*keys, CHUNK).agg(
            F.count(F.lit(1)).alias("_rows"),
            *[F.sum(e).alias(n) for n, e in sums.items()],
            *[F.max_by(e, F.when(e.isNotNull(), position)).alias(n) for n, e in lasts.items()],
        )
        return settle(per_chunk, "chunk-totals")

    totals = counted(rows)
    size = totals.agg(F.max("_rows").alias("most"), F.sum("_rows").alias("all")).first()
    if (size["most"] or 0) > most_rows:
        ranges = -(-2 * size["all"] // most_rows)
        ranged = df.repartitionByRange(ranges, *keys, *order).withColumn(CHUNK, F.spark_partition_id())
        rows = settle(ranged, "ranges")
        totals = counted(rows)
    before = (
        Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    )
    openings = totals.select(
        *keys,
        CHUNK,
        F.lit(0).alias(IS_ROW),
        *[F.sum(n).over(before).alias(f"_v_{n}") for n in sums],
        *[F.last(n, ignorenulls=True).over(before).alias(f"_v_{n}") for n in lasts],
    )
    values = rows.select(
        *df.columns,
        CHUNK,
        F.lit(1).alias(IS_ROW),
        *[e.alias(f"_v_{n}") for n, e in {**sums, **lasts}.items()],
    )
    along = Window.partitionBy(*keys, CHUNK).orderBy(IS_ROW, *order)
    inside = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    # Tasks by rows: merged by shuffled bytes, which repeated keys make few, tasks would grow with the table.
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-(size["all"] or 0) // TASK_ROWS))
    stacked = values.unionByName(openings, allowMissingColumns=True).repartition(tasks, *keys, CHUNK)
    return stacked.select(
        *df.columns,
        IS_ROW,
        *[F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)).alias(n) for n in sums],
        *[F.last(f"_v_{n}", ignorenulls=True).over(inside).alias(n) for n in carries],
        *[F.last(f"_v_{n}", ignorenulls=True).over(earlier).alias(n) for n in previous],
    ).where(F.col(IS_ROW) == 1).select(*df.columns, *names)


def time_chunk(ts: str, seconds: int = 86400) -> Column:
    """Chunk expression for rows ordered by a timestamp."""
    return F.floor(F.unix_micros(ts) / (seconds * 1_000_000))


def carry_header(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
    header: Column, name: str = "header",
) -> DataFrame:
    """Give every row the last header seen at or before it."""
    return running(df, keys, order, chunk, carries={name: header})


def segment_id(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
    starts: Column, name: str = "segment",
) -> DataFrame:
    """Number the segments opened by rows for which ``starts`` holds."""
    flag = F.when(starts, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    return running(df, keys, order, chunk, sums={name: flag})


def running_verdicts(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
    classes: Mapping[str, Column],
) -> DataFrame:
    """Cumulative count per verdict class, e.g. ok / bad / error."""
    flags = {
        n: F.when(c, F.lit(1)).otherwise(F.lit(0)).cast("bigint") for n, c in classes.items()
    }
    return running(df, keys, order, chunk, sums=flags)
