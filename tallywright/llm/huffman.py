"""Token-id files: canonical length-limited Huffman codes in independent blocks.

A folder holds three Parquet tables: ``codebook`` (id, length of its code), ``blocks`` (one row per
block) and ``index`` (ids before each part). A block holds whole documents and can be decoded alone;
its checkpoints are the bit offsets of every 128th id, so that any stretch can be decoded alone too.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywright.llm.rows import ship, small_batches
from tallywright.llm.tokens import id_counts, id_type
from tallywright.workspace import settle

BLOCK_IDS = 1 << 16
STEP = 128
LIMIT = 16


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits, by packages and merges.

    Each of ``limit`` levels merges the sorted counts with the pairs of the level before. Going
    back down, every count among the cheapest items taken adds one bit to its code.
    """
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError("more ids than codes of that length")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    level, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        items = np.concatenate([leaves, pairs])
        rank = np.argsort(items, kind="stable")
        level = items[rank]
        is_leaf.append(rank < n)
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for flags in reversed(is_leaf):
        taken = int(flags[:take].sum())
        lengths[order[:taken]] += 1
        take = 2 * (take - taken)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), each length's first code following from the one before."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    sorted_lengths = lengths[order]
    top = int(sorted_lengths[-1]) if len(order) else 0
    sizes = np.left_shift(1, top - sorted_lengths)
    starts = np.cumsum(sizes) - sizes
    codes = np.empty(len(lengths), np.int64)
    codes[order] = np.right_shift(starts, top - sorted_lengths)
    return codes


class Codec:
    """Tables for one codebook; code lengths are at most 24 bits."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.argsort(ids)
        ids, lengths = ids[order], lengths[order]
        codes = canonical_codes(lengths)
        size = int(ids[-1]) + 1 if len(ids) else 1
        self.length = np.zeros(size, np.int64)
        self.code = np.zeros(size, np.int64)
        self.length[ids], self.code[ids] = lengths, codes
        self.bits = int(lengths.max()) if len(ids) else 1
        rank = np.lexsort((ids, lengths))
        spans = np.left_shift(1, self.bits - lengths[rank])
        fill = (1 << self.bits) - int(spans.sum())
        self.symbol_at = np.concatenate([np.repeat(ids[rank], spans), np.zeros(fill, np.int64)]).astype(np.uint32)
        self.length_at = np.concatenate([np.repeat(lengths[rank], spans), np.ones(fill, np.int64)])

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits, and the bit offset of every :data:`STEP`-th id."""
        size = self.length[ids]
        after = np.cumsum(size)
        at = after - size
        n_bytes = (int(after[-1]) + 7) // 8 if len(ids) else 0
        first = at >> 3
        value = self.code[ids] << (32 - (at & 7) - size)
        out = np.zeros(n_bytes + 4)
        for k in range(4):
            out += np.bincount(first + k, weights=(value >> (24 - 8 * k)) & 255, minlength=n_bytes + 4)
        return out[:n_bytes].astype(np.uint8).tobytes(), at[::STEP]

    def decode(self, data: bytes, n: int, checkpoints: np.ndarray) -> np.ndarray:
        """All stretches between checkpoints step by step beside each other."""
        raw = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        end = 8 * (len(window) - 1)
        at = checkpoints.astype(np.int64)
        out = np.empty((len(at), STEP), np.uint32)
        shift = np.uint32(32 - self.bits)
        for k in range(STEP):
            look = (window[at >> 3] << (at & 7).astype(np.uint32)) >> shift
            out[:, k] = self.symbol_at[look]
            at = np.minimum(at + self.length_at[look], end)
        return out.reshape(-1)[:n]


BLOCKS = (
    "part int, block int, start long, n_ids long, bits binary, checkpoints array<bigint>, "
    "doc_ids array<bigint>, doc_sizes array<bigint>"
)


def write_ids(tokens: DataFrame, folder: str, limit: int = LIMIT, block_ids: int = BLOCK_IDS) -> None:
    """Write all rows of ``tokens`` (doc_id, width, ids; a written table) in order of doc_id.

    Rows that share a doc_id follow each other by length and content, those without one come first.
    Counts cover all rows. No rows make an empty folder of the same form.
    """
    spark = tokens.sparkSession
    counts = id_counts(tokens)
    ids = np.array(sorted(counts), np.int64)
    weights = np.array([counts[i] for i in ids.tolist()], np.int64)
    lengths = code_lengths(weights, max(limit, int(len(ids)).bit_length()))
    spark.createDataFrame(
        list(zip(ids.tolist(), lengths.tolist())), "id long, length int"
    ).coalesce(1).write.parquet(f"{folder}/codebook")
    book = spark.sparkContext.broadcast((ids, lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*book.value)
        part, block, start = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        each: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal block, start
            joined = np.concatenate(each)
            bits, marks = codec.encode(joined)
            values = [part, block, start, len(joined), bits, marks.tolist(), docs[:], [len(x) for x in each]]
            row = pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(values, kinds)],
                ["part", "block", "start", "n_ids", "bits", "checkpoints", "doc_ids", "doc_sizes"],
            )
            block, start = block + 1, start + len(joined)
            docs.clear()
            each.clear()
            return row

        many = pa.list_(pa.int64())
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), many, many, many]
        size = 0
        for batch in small_batches(batches):
            for doc, width, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = np.frombuffer(raw.as_py(), id_type(width)).astype(np.int64)
                docs.append(doc)
                each.append(found)
                size += len(found)
                if size >= block_ids:
                    yield close()
                    size = 0
        if docs:
            yield close()

    keys = ["doc_id", F.octet_length("ids"), F.xxhash64("ids")]
    ordered = tokens.select("doc_id", "width", "ids").repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")
    parts = (
        spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n"))
    )
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts.select("part", before.alias("before")).coalesce(1).write.parquet(f"{folder}/index")


def read_ids(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, with its ids if wanted."""
    book = spark.sparkContext.broadcast(
        [(r["id"], r["length"]) for r in spark.read.schema("id long, length int").parquet(f"{folder}/codebook").collect()]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(np.array([i for i, _ in book.value], np.int64), np.array([n for _, n in book.value], np.int64))
        for batch in small_batches(batches):
            for row in batch.to_pylist():
                ids = codec.decode(row["bits"], row["n_ids"], np.array(row["checkpoints"])).astype("<u4")
                after = np.cumsum(row["doc_sizes"])
                begin = after - row["doc_sizes"]
                raw = memoryview(ids.tobytes())
                spans = [raw[4 * a : 4 * b] for a, b in zip(begin.tolist(), after.tolist())]
                columns = [
                    pa.array([row["part"]] * len(spans), pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(begin + row["start"], pa.int64()),
                    pa.array(row["doc_sizes"], pa.int64()),
                    pa.array([zlib.crc32(x) for x in spans], pa.int64()),
                ]
                names = ["part", "doc_id", "start", "n_tokens", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array([bytes(x) for x in spans], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    ship(spark)
    schema = "part int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids
    found = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").mapInArrow(run, schema)
    index = spark.read.schema("part int, before long").parquet(f"{folder}/index")
    return found.join(index, "part").withColumn("start", F.col("start") + F.col("before")).drop("part", "before")
