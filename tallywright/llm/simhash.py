"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywright.llm.graph import components
from tallywright.llm.rows import ship, small_batches
from tallywright.workspace import settle

SHINGLE = 3
RADIUS = 2
SEED = 42
BLOCK = 1 << 15


def fingerprint(text: str | bytes | None, width: int = SHINGLE) -> int:
    """64-bit SimHash of a text's word shingles as a signed number; 0 without a word. Bytes are a text in UTF-8.

    A bit is set where over half of the shingles' XXH64 values, repeats included, have it set.
    ``bytes.lower`` and ``bytes.split`` touch ASCII only, which is the definition's A-Z and blanks.
    """
    words = (text if isinstance(text, bytes) else (text or "").encode()).lower().split()
    if not words:
        return 0
    if len(words) < width:
        words, width = [b" ".join(words)], 1
    total = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    for start in range(0, total, BLOCK):
        part = words[start : start + BLOCK + width - 1]
        grams = part if width == 1 else map(b" ".join, zip(*(part[k:] for k in range(width))))
        values = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)
        bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total).view(">i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            fps = [fingerprint(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    ship(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, fp long"
    )


def ball(radius: int) -> list[int]:
    """All 64-bit masks of at most ``radius`` bits, signed."""
    masks = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(64), n)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def near_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (fp, low) that connect all fingerprints within ``radius`` bits of each other.

    ``fps`` has each distinct fingerprint once. Each emits every variant within
    half the radius; two fingerprints within the radius share a variant, the meeting point. As the
    fingerprints are distinct, a variant has no more rows than its own ball, 65 at radius 2,
    whatever the data. Instead of all pairs, each is linked to the smallest one at its variant;
    the distance is checked again before a link is kept.
    """
    masks = F.array(*[F.lit(m).cast("long") for m in ball(radius // 2)])
    variants = fps.select("fp", F.explode(masks).alias("mask")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant")
    )
    met = variants.select("fp", F.min("fp").over(W.partitionBy("variant")).alias("low"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("low"))) <= radius
    return met.filter((F.col("fp") != F.col("low")) & near).distinct()


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Fingerprints at most ``radius`` (an even number) bits apart are linked; ``component_id`` is the
    smallest doc_id reachable. Null, empty and blank texts have fingerprint 0, which is linked like
    any other. Equal rows, and rows that share a doc_id, stay apart in the result; a row without
    doc_id gets its class all the same. Other columns are not read. Copies are merged first, so a
    group of copies of any size is one fingerprint.
    """
    if radius % 2:
        raise ValueError("radius must be even: the balls of two fingerprints meet half-way")
    rows = settle(fingerprints(docs, doc_id, text), "fingerprints")
    firsts = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(near_links(firsts.select("fp"), radius), "fp", "low").withColumnRenamed("node", "fp")
    least = roots.join(firsts, "fp").groupBy("root").agg(F.min("first").alias("least"))
    linked = roots.join(least, "root").select("fp", "least")
    classes = firsts.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return rows.join(classes, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents whose id is the smallest of their class, each id once.

    Rows without an id can't be told apart from their copies and stay.
    """
    first = near_duplicates(docs, doc_id, text).filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first.withColumnRenamed("doc_id", doc_id), doc_id, "left_semi").select(*docs.columns)
    return kept.dropDuplicates([doc_id]).unionByName(docs.filter(F.col(doc_id).isNull()))
