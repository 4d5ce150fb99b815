"""Files as rows: whole small documents, or ordered lines of logs of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Order of lines within a file, and the piece of the file they come from.
LINE_ORDER = ["block", "ln"]
MODEL_DIR = r"/([^/]+)/raw/"
MODEL_PARTITION = r"/model=([^/]+)/"


def model_of(path: Column) -> Column:
    """Model a file belongs to.

    It is the directory above ``raw``, else the ``model=`` partition, else the
    file's parent directory.
    """
    return F.coalesce(
        F.nullif(F.regexp_extract(path, MODEL_DIR, 1), F.lit("")),
        F.nullif(F.regexp_extract(path, MODEL_PARTITION, 1), F.lit("")),
        F.nullif(F.regexp_extract(path, r"/([^/=]+=)?([^/]+)/[^/]+$", 2), F.lit("")),
    )


def run_of(path: Column) -> Column:
    """File name without its extension."""
    return F.regexp_extract(path, r"/([^/]+?)(\.[A-Za-z]+)?$", 1)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: (file, text). For result documents of a few MB at most."""
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line: (file, block, ln, text).

    A large log is read by many tasks. ``block`` is the offset of the piece a
    line came from and ``ln`` grows within a piece, so ``(block, ln)`` is the
    line order without any file passing through one task. Carriage returns end
    lines too, which turns progress bars into one frame per row.
    """
    return spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("ln"),
        F.col("value").alias("text"),
    )
