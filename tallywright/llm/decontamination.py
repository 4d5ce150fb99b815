"""Benchmark passages in documents by Wu-Manber search for many strings at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.rows import ship, small_batches
from tallywright.workspace import settle

WINDOW = 10
#: Strings of at least so many bytes are searched together; short ones would shorten the steps of long ones.
CLASSES = (3, 8, 24)
#: Bytes of a block, at most; a table of shifts has 2^18 entries.
BLOCK, TABLE = 4, 18
#: Test words searched in one pass: each makes a string of about 60 bytes. More take more passes.
WORDS_AT_ONCE = 1 << 18
#: Places of a text searched in step with each other.
LANES = 4096

#: What isn't a word character becomes a space: all ASCII but digits and letters. A-Z are lower-cased.
PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_MIX = np.random.default_rng(12).integers(1, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(PLAIN).split()


def windows(words: list[bytes], width: int = WINDOW) -> list[bytes]:
    """Test strings of an item, a space around every word; fewer words than ``width`` are one string."""
    if not words:
        return []
    return [b" %b " % b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]


def blocks_at(data: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Table entry of the ``size`` bytes that end at (and with) each of ``end``."""
    value = data[end].astype(np.uint64)
    for k in range(1, size):
        value = value << np.uint64(8) | data[end - k]
    return (value * _ODD >> np.uint64(64 - TABLE)).astype(np.int64)


def hashes(data: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each of ``start``."""
    out = np.zeros(len(start), np.uint64)
    for k in range(size):
        out = (out ^ _MIX[k & 1][data[start + k]]) * _ODD
        out ^= out >> np.uint64(29)
    return out


class Searcher:
    """Wu-Manber tables of strings of similar length.

    The window is as long as the shortest string. ``shift`` says for a block of bytes how far the window
    may move when it ends with that block: to the block's last place in the first ``m`` bytes of any
    string. Where it is 0, the block and the first bytes of the window choose a bucket: strings of one
    beginning. A bucket knows the lengths of its strings; the text's hash at each of them finds the one
    string to compare byte by byte.
    """

    def __init__(self, strings: list[bytes]):
        self.m = min(map(len, strings))
        self.block = min(BLOCK, self.m)
        self.sizes = np.array([len(s) for s in strings], np.int64)
        self.pool = np.frombuffer(b"".join(strings), np.uint8)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.shift = np.full(1 << TABLE, self.m - self.block + 1, np.int32)
        for end in range(self.block - 1, self.m):
            np.minimum.at(self.shift, blocks_at(self.pool, self.begin + end, self.block), self.m - 1 - end)
        first = hashes(self.pool, self.begin, self.m)
        self.heads = np.unique(self._gate(self.pool, self.begin))
        #: For each length: the beginnings of its strings, and its strings by hash.
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in np.unique(self.sizes).tolist():
            which = np.flatnonzero(self.sizes == size)
            whole = hashes(self.pool, self.begin[which], size)
            order = np.argsort(whole)
            self.by_length[size] = np.unique(first[which]), whole[order], which[order]

    def _gate(self, data: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The window's last and first block as one number."""
        last = blocks_at(data, start + self.m - 1, self.block)
        return last << TABLE | blocks_at(data, start + self.block - 1, self.block)

    def candidates(self, data: np.ndarray) -> np.ndarray:
        """Starts of windows that end and begin like a string, found by steps of the shift table."""
        stop = len(data) - 1
        if len(data) < self.m:
            return np.zeros(0, np.int64)
        step = max(1, -(-len(data) // LANES))
        at = np.arange(0, len(data), step) + self.m - 1
        limit = at + step
        found = []
        while True:
            alive = (at < limit) & (at <= stop)
            if not alive.all():
                at, limit = at[alive], limit[alive]
            if not len(at):
                break
            jump = self.shift[blocks_at(data, at, self.block)]
            here = at[jump == 0] - (self.m - 1)
            if len(here):
                gate = self._gate(data, here)
                slot = np.searchsorted(self.heads, gate)
                slot[slot == len(self.heads)] = 0
                found.append(here[self.heads[slot] == gate])
            at = at + np.maximum(jump, 1)
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def occurrences(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, string) of every place where a string stands in ``data``."""
        start = self.candidates(data)
        head = hashes(data, start, self.m)
        starts, strings = [], []
        for size, (begins, whole, which) in self.by_length.items():
            slot = np.searchsorted(begins, head)
            slot[slot == len(begins)] = 0
            own = start[(begins[slot] == head) & (start + size <= len(data))]
            found = hashes(data, own, size)
            slot = np.searchsorted(whole, found)
            slot[slot == len(whole)] = 0
            same = whole[slot] == found
            own, string = own[same], which[slot[same]]
            equal = np.ones(len(own), bool)
            for k in range(size):
                equal &= data[own + k] == self.pool[self.begin[string] + k]
            starts.append(own[equal])
            strings.append(string[equal])
        return np.concatenate(starts), np.concatenate(strings)


class Passages:
    """Searchers for the strings of some items, and whose strings they are."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], width: int = WINDOW):
        self.names = sorted({name for name, _ in items if name is not None})
        number = {name: k for k, name in enumerate(self.names)} | {None: -1}
        owners: dict[bytes, set[int]] = {}
        for name, text in items:
            for string in windows(words_of(text), width):
                owners.setdefault(string, set()).add(number[name])
        self.parts = []
        for low, high in zip(CLASSES, [*CLASSES[1:], 1 << 62]):
            strings = [s for s in owners if low <= len(s) < high]
            if strings:
                whose = [sorted(owners[s]) for s in strings]
                count = np.array([len(w) for w in whose], np.int64)
                n_words = np.array([s.count(b" ") - 1 for s in strings], np.int64)
                self.parts.append(
                    (Searcher(strings), n_words, np.concatenate([np.array(w, np.int64) for w in whose]), np.cumsum(count) - count, count)
                )

    def search(self, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """(number of words, runs [from, to) of hit words, items found) for each text."""
        each = [words_of(t) for t in texts]
        raw = b"".join([b" %b \n" % b" ".join(w) if w else b"\n" for w in each])
        data = np.frombuffer(raw, np.uint8)
        spaces = data == 32
        begins = np.zeros(len(data), np.int64)
        np.cumsum(spaces[:-1] & ~spaces[1:] & (data[1:] != 10), out=begins[1:])  # words begun up to here
        counts = np.array([len(w) for w in each], np.int64)
        before = np.cumsum(counts) - counts
        marks = np.zeros(int(counts.sum()) + 1, np.int64)
        codes = [np.zeros(0, np.int64)]
        for searcher, n_words, owners, first, many in self.parts:
            start, string = searcher.occurrences(data)
            word = begins[start + 1] - 1
            np.add.at(marks, word, 1)
            np.add.at(marks, word + n_words[string], -1)
            times = many[string]
            at = np.repeat(first[string] - np.cumsum(times) + times, times) + np.arange(times.sum())
            # The last text that begins at or before the word; texts without words begin there as well.
            text = np.searchsorted(before, np.repeat(word, times), side="right") - 1
            codes.append(np.unique(text * (len(self.names) + 1) + owners[at] + 1))
        hit = np.concatenate([[False], np.cumsum(marks) > 0, [False]])
        cuts = np.flatnonzero(hit[1:] != hit[:-1])
        out: list[tuple[int, list, list]] = [(n, [], []) for n in counts.tolist()]
        ends = before + counts
        for a, b in zip(cuts[::2].tolist(), cuts[1::2].tolist()):
            text = int(np.searchsorted(before, a, side="right")) - 1
            while a < b:  # runs of neighbouring texts may touch
                stop = min(b, int(ends[text]))
                if a < stop:
                    out[text][1].append((a - int(before[text]), stop - int(before[text])))
                a, text = stop, text + 1
        for code in np.unique(np.concatenate(codes)).tolist():
            text, owner = divmod(code, len(self.names) + 1)
            if owner:
                out[text][2].append(self.names[owner - 1])
        return out


def passes(items: DataFrame, most: int) -> list[DataFrame]:
    """The items in parts of about ``most`` words; one part if they have no more."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // (2 * most)))  # a word and its space have two bytes at least
    part = F.pmod(F.xxhash64("text"), F.lit(n))
    return [items.filter(part == k) for k in range(n)] if n > 1 else [items]


def find_passages(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WINDOW,
    words_at_once: int = WORDS_AT_ONCE,
) -> DataFrame:
    """(doc_id, n_words, spans, items) for every row of ``docs``.

    ``spans`` are the runs [from, to) of words inside any occurrence of a test window, in order and
    apart; ``items`` the items (as strings, in order) with a window in the text. A window is ``width``
    consecutive words of an item; an item of fewer words is one window, one without words has none.

    The items are read by the driver, in parts of bounded size; each part's tables go to all tasks, and
    each part takes a pass over the documents (one, up to a quarter of a million test words). The rows of
    several passes are merged by row. Null and empty texts have no words. Repeated rows, rows that share
    a doc_id and rows without one each get their row. Items of equal id are one item; windows of an item
    without id count as hits but name no item. No documents give no rows; without items nothing is hit.
    """
    known = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).alias("text")).filter(
        F.col("text").isNotNull()
    )
    parts = passes(known, words_at_once)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    if len(parts) > 1:
        rows = settle(rows.withColumn("row", F.monotonically_increasing_id()), "numbered-texts")
    else:
        rows = rows.withColumn("row", F.lit(0).cast("long"))
    spark = docs.sparkSession
    ship(spark)
    found = None
    for part in parts:
        read = [(r["item_id"], r["text"].encode()) for r in part.distinct().collect()]
        tables = spark.sparkContext.broadcast(Passages(read, width))

        def run(batches: Iterator[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
            passages = tables.value
            span = pa.struct([("from", pa.int64()), ("to", pa.int64())])
            for batch in small_batches(batches, 2 << 20):
                got = passages.search([t.as_buffer().to_pybytes() if t.is_valid else None for t in batch.column(2)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array([g[0] for g in got], pa.int64()),
                        pa.array([[{"from": a, "to": b} for a, b in g[1]] for g in got], pa.list_(span)),
                        pa.array([g[2] for g in got], pa.list_(pa.string())),
                    ],
                    ["row", "doc_id", "n_words", "spans", "items"],
                )

        one = rows.select("row", "doc_id", "text").mapInArrow(
            run,
            "row long, doc_id long, n_words long, spans array<struct<from: long, to: long>>, items array<string>",
        )
        found = one if found is None else found.unionByName(one)
    if len(parts) > 1:
        found = found.groupBy("row").agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            merged(F.array_sort(F.flatten(F.collect_list("spans")))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
    return found.drop("row")


def merged(spans):
    """Runs of an ordered list joined where they touch or overlap."""

    def add(out, x):
        last = F.element_at(out, -1)
        grown = F.concat(
            F.slice(out, 1, F.size(out) - 1),
            F.array(F.struct(last["from"].alias("from"), F.greatest(last["to"], x["to"]).alias("to"))),
        )
        return F.when((F.size(out) > 0) & (x["from"] <= F.try_element_at(out, F.lit(-1))["to"]), grown).otherwise(
            F.concat(out, F.array(x))
        )

    return F.aggregate(spans, F.slice(spans, 1, 0), add)


def contaminated_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``."""
    found = find_passages(docs, items, **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
