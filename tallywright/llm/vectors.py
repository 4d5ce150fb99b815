"""Embedding near-duplicates by Euclidean p-stable hashing with exact cosine checks."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.llm.graph import components
from tallywright.llm.rows import ship, small_batches
from tallywright.workspace import settle

THRESHOLD = 0.9
WIDTH = 2.0
RECALL = 0.99
#: Vectors that a bucket holds by chance, on average.
CROWD = 64
#: Rows of a bucket that are compared at once; larger buckets are dealt out in pairs of blocks.
BLOCK = 1024
SEED = 11


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that one quantised projection puts two vectors this far apart into one cell."""
    r = width / distance
    tail = math.erfc(r / math.sqrt(2)) / 2
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(projections per table, tables) for ``n`` distinct vectors.

    Projections leave about :data:`CROWD` unrelated vectors (at right angles) in a bucket; the
    tables find a pair exactly at the threshold with chance ``recall``, and closer pairs more surely.
    """
    far, near = collision(math.sqrt(2)), collision(math.sqrt(2 * (1 - threshold)))
    k = max(1, math.ceil(math.log(max(n, 1) / CROWD) / -math.log(far))) if n > CROWD else 1
    return k, max(1, math.ceil(math.log(1 - recall) / math.log1p(-(near**k))))


def unit(x: np.ndarray | None) -> np.ndarray | None:
    """The vector at length 1 in double precision; None if it is null, empty, zero or not finite."""
    if x is None or not isinstance(x, np.ndarray) or not x.size:
        return None
    x = x.astype(np.float64)
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0:
        return None
    x = x / top
    return x / math.sqrt(float(x @ x))


def signatures(units: np.ndarray, k: int, tables: int) -> np.ndarray:
    """A 32-bit bucket number per vector and table."""
    dim = units.shape[1]
    rng = np.random.default_rng([SEED, dim])
    cells = np.floor((units @ rng.standard_normal((dim, k * tables)) + rng.uniform(0, WIDTH, k * tables)) / WIDTH)
    odd = rng.integers(1, 1 << 62, (tables, k), dtype=np.int64) * 2 + 1
    mixed = (cells.astype(np.int64).reshape(-1, tables, k) * odd).sum(axis=2) + dim
    return ((mixed ^ (mixed >> 31)) * np.int64(0x5851F42D4C957F2D) >> 32).astype(np.int32)


def _compare(batch: list[tuple], t: int, threshold: float, whole: bool) -> Iterator[tuple]:
    """(key, other, n) for one pair of blocks: ``other`` null with the links found, or one connection.

    ``batch`` rows: (key, unit, sigs, n, in_second). A pair that an earlier table has put together
    counts there.
    """
    for dim in {len(r[1]) for r in batch}:
        rows = [r for r in batch if len(r[1]) == dim]
        units, sigs = np.stack([r[1] for r in rows]), np.stack([r[2] for r in rows])[:, :t]
        n = np.array([r[3] for r in rows], np.int64)
        second = np.ones(len(rows), bool) if whole else np.array([r[4] for r in rows])
        left = np.arange(len(rows)) if whole else np.flatnonzero(~second)
        right = np.flatnonzero(second)
        found_a, found_b = [], []
        for start in range(0, len(left), 256):
            part = left[start : start + 256]
            i, j = np.nonzero(units[part] @ units[right].T >= threshold)
            a, b = part[i], right[j]
            if whole:
                a, b = a[a < b], b[a < b]
            for at in range(0, len(a), 1 << 16):
                x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
                new = ~(sigs[x] == sigs[y]).any(axis=1)
                found_a.append(x[new])
                found_b.append(y[new])
        a, b = np.concatenate([*found_a, left[:0]]), np.concatenate([*found_b, left[:0]])
        if not len(a):
            continue
        links = np.bincount(a, n[b], len(rows)) + np.bincount(b, n[a], len(rows))
        label = np.arange(len(rows))
        while True:
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            if (before == label).all():
                break
        for i in np.flatnonzero(links):
            yield rows[i][0], None, int(links[i])
            if label[i] != i:
                yield rows[i][0], rows[label[i]][0], 0


def near_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
    threshold: float = THRESHOLD, recall: float = RECALL,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Rows whose vectors have a cosine of at least ``threshold`` are linked; ``component_id`` is the
    smallest vec_id reachable, and rows that carry it are kept. A vector that is null, empty or zero,
    or holds a null or non-finite component, links with nothing, nor do vectors of different length.
    Repeated rows are vectors of their own and link with each other. Other columns are not read.

    Equal vectors are merged first. Each table buckets all distinct vectors; buckets of over
    :data:`BLOCK` rows are dealt out as pairs of blocks, so that no task holds a whole hot bucket,
    and no pair leaves a task: only each vector's number of links and what joins its block.
    """
    ship(vectors.sparkSession)
    double = isinstance(vectors.schema[embedding].dataType.elementType, T.DoubleType)
    kind = np.dtype("<f8" if double else "<f4")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            raw = []
            for x in batch.column(1).to_numpy(zero_copy_only=False):
                raw.append(None if unit(x) is None else x.astype(kind).tobytes())
            keys = [None if x is None else hashlib.blake2b(x, digest_size=16).digest() for x in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "key", "vec"]
            )

    source = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("e"))
    rows = settle(source.mapInArrow(read, "vec_id long, key binary, vec binary"), "vectors")
    classes = settle(
        rows.filter("key is not null").groupBy("key").agg(
            F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"), F.first("vec").alias("vec")
        ),
        "distinct-vectors",
    )
    k, tables = plan(classes.count(), threshold, recall)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1 << 20):
            units = [unit(np.frombuffer(v, kind)) for v in batch.column(2).to_pylist()]
            out = [b""] * len(units)
            for dim in {len(u) for u in units}:
                at = [i for i, u in enumerate(units) if len(u) == dim]
                for i, s in zip(at, signatures(np.stack([units[i] for i in at]), k, tables)):
                    out[i] = s
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([s.tolist() for s in out], pa.list_(pa.int32()))], ["key", "n", "vec", "sigs"]
            )

    signed = settle(
        classes.select("key", "n", "vec").mapInArrow(sign, "key binary, n long, vec binary, sigs array<int>"), "signed"
    )
    places = signed.select("key", F.posexplode("sigs").alias("t", "sig"))
    sizes = places.groupBy("t", "sig").count().filter("count > 1")
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least(o, F.col("own")).alias("lo"), F.greatest(o, F.col("own")).alias("hi")),
    )
    dealt = (
        signed.select("*", F.posexplode("sigs").alias("t", "sig"))
        .join(sizes.withColumn("blocks", blocks), ["t", "sig"])
        .withColumn("own", own)
        .select("t", "sig", "own", F.explode(cells).alias("cell"), "key", "n", "vec", "sigs")
        .select("t", "sig", "cell.lo", "cell.hi", "own", "key", "n", "vec", "sigs")
    )
    at = ["t", "sig", "lo", "hi"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now: tuple | None = None
        out: list[tuple] = []

        def send() -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*out), (pa.binary(), pa.binary(), pa.int64()))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["key", "other", "n"])

        for batch in small_batches(batches):
            columns = [batch.column(i).to_pylist() for i in range(8)]
            sigs = batch.column(8).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for i, (t, sig, lo, hi, own_block, key, n, vec) in enumerate(zip(*columns)):
                if (t, sig, lo, hi) != now:
                    if len(held) > 1:
                        out.extend(_compare(held, now[0], threshold, now[2] == now[3]))
                    held, now = [], (t, sig, lo, hi)
                    if len(out) > 4096:
                        yield send()
                held.append((key, unit(np.frombuffer(vec, kind)), sigs[i], n, own_block == hi))
        if len(held) > 1:
            out.extend(_compare(held, now[0], threshold, now[2] == now[3]))
        if out:
            yield send()

    found = settle(
        dealt.repartition(*at).sortWithinPartitions(*at, "own").mapInArrow(check, "key binary, other binary, n long"),
        "vector-links",
    )
    links = found.filter("other is null").groupBy("key").agg(F.sum("n").alias("links"))
    roots = components(found.filter("other is not null"), "key", "other").withColumnRenamed("node", "key")
    least = roots.join(classes.select("key", "first"), "key").groupBy("root").agg(F.min("first").alias("least"))
    linked = roots.join(least, "root").select("key", "least")
    each = (
        classes.select("key", "n", "first").join(links, "key", "left").join(linked, "key", "left")
        .select(
            "key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("least", "first").alias("component_id"),
        )
    )
    valid = rows.filter("key is not null").select("vec_id", "key").join(each, "key").select("vec_id", "n_links", "component_id")
    alone = rows.filter("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return valid.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
