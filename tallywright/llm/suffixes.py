"""Removal of repeated byte strings by distributed prefix doubling over sampled suffixes.

A suffix array of every byte would hold a row per byte. Here the suffixes start at anchors instead:
the position with the smallest hash in each window of 128 positions, about one in 64. Equal strings
have equal windows, so every repeated 400-byte string has the same anchor at the same offset in all
its places, and an anchor's suffix repeats for at least the bytes that all of them share. Prefix
doubling finds the anchors whose suffix repeats that far; an exact byte-level step follows for them.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.rows import ship, small_batches
from tallywright.workspace import settle, shared_dir

LENGTH = 400
WINDOW = 128
GRAM = 8
FIRST = 64
#: Bytes after an anchor that belong to every string it stands for.
REACH = LENGTH - WINDOW + 1
#: Bytes that decide which anchor follows.
DECIDE = WINDOW + GRAM
#: Bytes of texts that are worked through as one string.
AT_ONCE = 1 << 17

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_rng = np.random.default_rng(5)
_MIX = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD6E8FEB86659FD93


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C1
    x = (x ^ (x >> np.uint64(29))) * _C2
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text of 400 bytes or more, in order: which text, anchor, first and last start of a string that it
    stands for, and hash of the 64 bytes from the anchor on.

    Every start of a 400-byte string belongs to one anchor, less than 128 bytes ahead of it. Later
    anchors, which only continue suffixes, have a first start after their last. Anchors with fewer than
    64 bytes behind them are left out. The texts are worked through as one string; windows lie within a text.
    """
    size = np.array([len(t) for t in texts], np.int64)
    data = b"".join(texts)
    n = len(data) - GRAM + 1
    # The eight bytes from each position as one number.
    grams = np.ndarray((n,), "<u8", data, strides=(1,)).copy()
    low = _mixed(grams)
    low &= np.uint64(0xFFFFFFFF00000000)
    low |= np.arange(n, dtype=np.uint64)
    step = 1
    while step < WINDOW:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    chosen = low.view("<u4")[::2]
    windows = size - (GRAM + WINDOW - 2)
    ends = np.cumsum(size)
    begins = ends - size
    # A text's last windows reach into the next one and are no windows.
    change = np.flatnonzero(chosen[1:] != chosen[:-1]) + 1
    first = np.union1d(change, begins)
    text = np.searchsorted(ends, first, side="right")
    own = first - begins[text] < windows[text]
    first, text = first[own], text[own]
    at, begin = chosen[first].astype(np.int64), begins[text]
    last = np.append(first[1:] - 1, 0)
    tail = np.append(text[1:] != text[:-1], True)
    last[tail] = (begins + windows - 1)[text[tail]]
    whole = at + FIRST <= ends[text]
    text, at, begin, first, last = (x[whole] for x in (text, at, begin, first, last))
    name = np.zeros(len(at), np.uint64)
    for k in range(0, FIRST, GRAM):
        name = _mixed(name ^ grams[at + k]) + np.uint64(k)
    return text, at - begin, first - begin, np.minimum(last - begin, size[text] - LENGTH), name.view(np.int64)


def offsets() -> list[int]:
    """Offsets of the doubling rounds: each at most the length ranked so far, all within reach."""
    out, covered, ranked = [], FIRST, FIRST
    while (gap := min(covered, REACH - ranked)) >= GRAM:
        out.append(gap)
        ranked = max(ranked + gap, gap + DECIDE)
        covered = covered + gap
    return out


ROUNDS = offsets()


def _partners(at: np.ndarray, end: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor the steps to the last one at most ``most`` bytes on, and its distance; 0 without.

    ``at`` ascends, ``end`` is the index of the last anchor of the same text. An anchor counts only if
    the bytes that decide it are in reach.
    """
    last = np.minimum(np.searchsorted(at, at + most, side="right") - 1, end)
    sure = np.searchsorted(at, at + REACH - DECIDE, side="right")
    step = np.minimum(last, sure) - np.arange(len(at))
    return step, at[np.arange(len(at)) + step] - at


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Neighbouring texts together up to :data:`AT_ONCE` bytes, with the number of texts before them."""
    start = size = 0
    for k, text in enumerate(texts):
        if k > start and size + len(text) > AT_ONCE:
            yield start, texts[start:k]
            start, size = k, 0
        size += len(text)
    if texts:
        yield start, texts[start:]


def _read(texts: DataFrame) -> DataFrame:
    """(key, idx, name, anchor, first, last, step0, gap0, ...); name: hash of the first 64 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1 << 20):
            raw = [t.as_buffer().to_pybytes() for t in batch.column(1)]
            long = [k for k, t in enumerate(raw) if len(t) >= LENGTH]
            keys = batch.column(0).take(pa.array(long, pa.int64()))
            for before, block in _blocks([raw[k] for k in long]):
                text, at, first, last, name = anchors(block)
                head = np.searchsorted(text, np.arange(len(block) + 1))
                places = [x.astype(np.int32) for x in (np.arange(len(at)) - head[text], at, first, last)]
                columns = [keys.take(pa.array(text + before)), pa.array(places[0]), pa.array(name), *map(pa.array, places[1:])]
                # Texts further apart than any anchor of one text looks ahead.
                begins = np.cumsum([0] + [len(t) + LENGTH for t in block])[:-1]
                for gap in ROUNDS:
                    columns += [pa.array(x.astype(np.int16)) for x in _partners(begins[text] + at, head[text + 1] - 1, gap)]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["key", "idx", "name", "anchor", "first", "last"] + [f"{c}{k}" for k in range(len(ROUNDS)) for c in ("step", "gap")]
    schema = "key binary, idx int, name long, anchor int, first int, last int" + "".join(f", step{k} short, gap{k} short" for k in range(len(ROUNDS)))
    return texts.select("key", "text").mapInArrow(run, schema)


def _repeated(named: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose name occurs twice or more. Counts combine before the shuffle, and Spark may split
    the join, so a name may have any number of rows."""
    twice = named.groupBy(*on).count().filter("count > 1").drop("count")
    return named.join(twice, on)


def repeated_anchors(texts: DataFrame) -> DataFrame:
    """(key, anchor, name, first, last): anchors whose suffix occurs again as far as the doubling reaches.

    Round by round an anchor's name becomes the sorted pair of its own name and that of the anchor
    ``gap`` bytes on; names that are unique leave, as does whatever has a unique name further on.
    """
    left = settle(_repeated(settle(_read(texts), "suffix-anchors"), ["name"]), "suffix-names")
    for k in range(len(ROUNDS)):
        ahead = left.select("key", F.col("idx").alias("next"), F.col("name").alias("second"))
        step = left.withColumn("next", F.col("idx") + F.col(f"step{k}"))
        paired = step.join(ahead, ["key", "next"]).withColumn(
            "name", F.xxhash64("name", f"gap{k}", "second")
        ).drop("next", "second")
        left = settle(_repeated(paired, ["name"]), f"suffix-names-{k + 1}")
    return left.filter("first <= last").select("key", "anchor", "name", "first", "last")


#: Starts that one row stands for, round by round; at 1 a row is one string.
GRIDS = (WINDOW, 16, 1)
PARTS = "key binary, anchor int, name long, part int, first int, last int, core long, whole long"


def _parts(grid: int):
    """Rows for stretches of at most ``grid`` starts, by their distance from the anchor.

    ``core`` hashes the bytes that all strings of the stretch share, ``whole`` those that any has.
    The core's place depends on the anchor alone, so equal strings have equal cores.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = inverse = np.ones(1, np.uint64)
        for batch in small_batches(batches, 1 << 20):
            count = batch.column(2).value_lengths().to_numpy()
            cuts = np.concatenate([[0], np.cumsum(count)])
            anchors_, names_, firsts, lasts = (x.to_numpy() for x in batch.column(2).flatten().flatten())
            for before, block in _blocks([t.as_buffer().to_pybytes() for t in batch.column(1)]):
                data = np.frombuffer(b"".join(block), np.uint8)
                if len(power) <= len(data):
                    power, inverse = (_powers(x, 2 * len(data)) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
                total = np.zeros(len(data) + 1, np.uint64)
                np.cumsum(_MIX[data] * power[: len(data)], out=total[1:])
                own = slice(cuts[before], cuts[before + len(block)])
                anchor, first, last = (x[own].astype(np.int64) for x in (anchors_, firsts, lasts))
                text = np.repeat(np.arange(len(block)), count[before : before + len(block)])
                low, high = (anchor - last) // grid, (anchor - first) // grid
                n = high - low + 1
                at = np.repeat(np.arange(len(anchor)), n)
                part = low[at] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                near = anchor[at] - part * grid
                far = near - grid + 1
                begin, end = np.maximum(far, first[at]), np.minimum(near, last[at])
                base = np.cumsum([0] + [len(t) for t in block])[text[at]]

                def digest(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                    return _mixed((total[base + j] - total[base + i]) * inverse[base + i]).view(np.int64)

                keys = batch.column(0).take(pa.array(text[at] + before))
                values = [anchor[at], names_[own][at], part, begin, end, digest(near, far + LENGTH), digest(begin, end + LENGTH)]
                kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                columns = [pa.array(c, t) for c, t in zip(values, kinds)]
                yield pa.RecordBatch.from_arrays([keys, *columns], [x.split()[0] for x in PARTS.split(", ")])

    return run


def repeated_ranges(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(key, first, last): the starts of all 400-byte strings that occur again.

    ``found`` has the candidates (key, anchor, name, first, last). Of each stretch of starts, all
    repeat if its whole bytes do, none if its core doesn't; what is left between is looked at in
    finer stretches, one row for all that have the same bytes, down to single strings.
    """
    ranges = None
    for grid in GRIDS:
        item = F.struct("anchor", "name", "first", "last")
        asked = texts.select("key", "text").join(found.groupBy("key").agg(F.collect_list(item).alias("found")), "key")
        rows = settle(asked.select("key", "text", "found").mapInArrow(_parts(grid), PARTS), f"suffix-parts-{grid}")
        group = ["name", "part", "core"]
        alive = _repeated(rows, group)
        same = settle(
            alive.groupBy(*group, "whole").agg(
                F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "anchor", "first", "last")).alias("x")
            ),
            f"suffix-same-{grid}",
        )
        settled = rows.join(same.filter("n > 1").select(*group, "whole"), [*group, "whole"]).select("key", "first", "last")
        ranges = settled if ranges is None else ranges.unionByName(settled)
        if grid > 1:
            open_groups = same.filter("n = 1").select(*group).distinct()
            found = same.join(open_groups, group).select("x.*", F.xxhash64(*group).alias("name"))
    return ranges


RESULT = "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4 << 20):
            count = batch.column(3).value_lengths().fill_null(0).to_numpy()
            cuts = np.concatenate([[0], np.cumsum(count)])
            firsts, lasts = (x.to_numpy() for x in batch.column(3).flatten().flatten())
            copies = batch.column(2).to_numpy()
            for before, block in _blocks([t.as_buffer().to_pybytes() for t in batch.column(1)]):
                here = slice(before, before + len(block))
                own = slice(cuts[before], cuts[before + len(block)])
                size = np.array([len(t) for t in block], np.int64)
                ends = np.cumsum(size)
                begins = ends - size
                data = np.frombuffer(b"".join(block), np.uint8)
                text = np.repeat(np.arange(len(block)), count[here])
                whole = np.flatnonzero((copies[here] > 1) & (size >= LENGTH))
                a = np.concatenate([begins[text] + firsts[own], begins[whole]])
                b = np.concatenate([begins[text] + lasts[own] + LENGTH, ends[whole]])
                order = np.argsort(a, kind="stable")
                text, a, b = np.concatenate([text, whole])[order], a[order], np.maximum.accumulate(b[order])
                fresh = np.flatnonzero(np.concatenate([[True], (a[1:] > b[:-1]) | (text[1:] != text[:-1])])[: len(a)])
                text, a, b = text[fresh], a[fresh], b[np.append(fresh[1:], len(b))[: len(fresh)] - 1]
                removed = np.bincount(text, b - a, len(block)).astype(np.int64)
                edge = np.zeros(len(data) + 1, np.int8)
                edge[a] += 1
                edge[b] -= 1
                kept = data[np.cumsum(edge[:-1], dtype=np.int8) == 0].tobytes()
                stops = np.cumsum(size - removed).tolist()
                rest = [kept[i:j] for i, j in zip([0, *stops], stops)]
                columns = [batch.column(0)[here], pa.array(size), pa.array(removed), pa.array(np.bincount(text, minlength=len(block)))]
                columns.append(pa.array([hashlib.sha256(r).hexdigest() for r in rest], pa.string()))
                names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text
                yield pa.RecordBatch.from_arrays(columns + [pa.array(rest, pa.binary())] * keep_text, names)

    return run


def _key(text: str) -> F.Column:
    """96 bits that name a text; enough for 10^12 texts."""
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)), 1, 12)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256 [, kept bytes]) for every row of ``docs``.

    Texts are UTF-8 bytes, null texts empty. Every byte covered by a 400-byte string that also starts
    elsewhere, in any row or further on in the same one, is removed; strings are judged on the input.
    So a repeated row of 400 bytes or more loses all its bytes, a shorter text none. Rows are taken
    as they come, also those that share a doc_id or have none; other columns are not read.

    Equal texts are merged first and written in buckets of their key, so that each later step joins
    its few rows to the texts without moving these again.
    """
    spark = docs.sparkSession
    ship(spark)
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _key(text).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    merged = keyed.groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    name = f"suffix_texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    merged.write.option("path", shared_dir(spark, "suffix-texts")).option("compression", "zstd").bucketBy(
        buckets, "key"
    ).saveAsTable(name)
    texts = spark.table(name)
    ranges = repeated_ranges(texts, repeated_anchors(texts))
    ranges = ranges.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    result = settle(
        texts.join(ranges, "key", "left").select("key", "text", "copies", "ranges").mapInArrow(
            _cut(keep_text), RESULT + ", kept binary" * keep_text
        ),
        "suffix-result",
    )
    spark.sql(f"DROP TABLE {name}")
    return keyed.select("doc_id", "key").join(result, "key").drop("key")
