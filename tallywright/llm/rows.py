"""Small helpers shared by the operators: columns, words, Python-side batches."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and U+0009 to U+000D. ``bytes.split()`` uses the same six.
SPACES = " \t\n\x0b\f\r"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once per application, wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        parent, name = os.path.split(package)
        base = os.path.join(tempfile.mkdtemp(prefix="run-"), name)
        context.addPyFile(shutil.make_archive(base, "zip", parent, name))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, also inside higher-order functions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    """Maximal runs of characters outside :data:`SPACES`; null text has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(spaced, " "), "")


def with_columns(df: DataFrame, names: list[str], record: str) -> DataFrame:
    """Columns ``names`` of struct column ``record`` beside ``df``'s own.

    An own column with one of the names (in any case) is replaced.
    """
    taken = {name.lower() for name in names} | {record.lower()}
    own = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return df.select(*own, *[F.col(f"{record}.{n}").alias(n) for n in names])


def small_batches(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes, so that long texts don't add up."""
    for batch in batches:
        step = max(1, batch.num_rows * most // max(batch.nbytes, most))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)
