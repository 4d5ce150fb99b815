"""Shared folders for written intermediate tables and stream checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the one the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting falls back to a folder
    under ``/tmp``; on a cluster a missing setting is an error, since a
    machine-local folder would not survive the loss of an executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = _local_roots.setdefault(
            context.applicationId, tempfile.mkdtemp(prefix="run-", dir="/tmp")
        )
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def settle(df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    This cuts the lineage in a way that outlives executors, and it gives the
    planner the table's real size: a small result is broadcast to the side it
    is joined with, which then need not be shuffled, while a large one is
    merged as usual.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(table: DataFrame, key: str) -> DataFrame:
    """Give every core a share of a table that arrives in fewer splits than that.

    For stages that compute much per byte read. Rows are placed by a hash of
    ``key``, so a repeated task sees the same rows. A table with enough splits
    is returned as it is, so at scale no shuffle is added.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores, key) if table.rdd.getNumPartitions() < cores else table
