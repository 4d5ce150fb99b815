"""Alignment of two tokenizers' ids over a corpus, each distinct text done once."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywright.llm.rows import ship, small_batches
from tallywright.workspace import settle

#: Parts of texts remembered by a worker; one of over 64 bytes is worked out each time.
MOST_PARTS, LONGEST_PART = 1 << 19, 64
#: Longer texts are worked through in segments of about so many bytes.
SEGMENT = 1 << 20
#: New parts are encoded in texts of about so many bytes; pairs of a group with more are counted by distinct ids.
JOINED, LARGE_GROUP = 1 << 14, 1 << 12
#: Id pairs held by a worker at once: 17 bytes each. More pairs take more passes over the written alignments.
PAIRS_AT_ONCE = 1 << 22
#: A text with more copies than this is joined in several tasks; so are at most one in this many rows' texts.
COPIES_A_TASK = 10_000
#: A space after another character than a space, before one that is surely no white space. Both tokenizers
#: start a token there whatever stands around it.
CUT = re.compile(rb"(?<! ) (?=[!-~\xc3-\xdf])")
SURE = frozenset([*range(0x21, 0x7F), *range(0xC3, 0xE0)])

MEASURES = ["n_a", "n_b", "n_groups", "n_links"]


def byte_alphabet() -> dict[str, int]:
    """The character of each byte in a byte-level vocabulary: printable bytes are themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def spread_out(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... (``many`` of them) of each entry, one after the other."""
    return np.arange(int(many.sum())) + np.repeat(first - np.cumsum(many) + many, many)


def segments(text: bytes) -> list[bytes]:
    """The text in pieces of about :data:`SEGMENT` bytes, cut at places of :data:`CUT`."""
    out, start = [], 0
    while cut := CUT.search(text, start + SEGMENT):
        out.append(text[start : cut.start()])
        start = cut.end()
    return [*out, text[start:]]


def distinct_sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with the sum of its values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True] * (len(keys) > 0), keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values, first) if len(first) else values


class Aligner:
    """Both tokenizers, and a memory of aligned parts of texts.

    A text with a space before it is cut at :data:`CUT`. Neither tokenizer's tokens cross such a
    place: A's pattern starts a word there, and no piece of B has a space after another character
    (the constructor checks both). So the joined results of the parts are the result of the text, and
    parts may be encoded side by side in one text.
    """

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(byte_level), SentencePieceProcessor(model_file=pieces)
        self.a.encode_special_tokens = True
        if self.a.normalizer is not None or "use_regex=True" not in str(self.a.pre_tokenizer):
            raise ValueError("the first tokenizer must be byte-level BPE over words")
        names = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁", x) for x in names):
            raise ValueError("pieces of the second tokenizer must not cross words")
        byte = byte_alphabet()
        self.bytes_a = [
            bytes(byte[c] for c in x) if all(c in byte for c in x) else x.encode()
            for x in map(self.a.id_to_token, range(self.a.get_vocab_size()))
        ]
        self.bytes_b = [
            bytes([int(x[3:5], 16)]) if self.b.is_byte(k) else x.replace("▁", " ").encode() for k, x in enumerate(names)
        ]
        self.size_a, self.size_b = (np.array(list(map(len, x))) for x in (self.bytes_a, self.bytes_b))
        self.n_b = len(names)
        self.kind = np.dtype("<u4" if len(self.bytes_a) * self.n_b <= 1 << 32 else "<u8")
        digits = [str(k).encode() for k in range(max(len(self.bytes_a), self.n_b))]
        self.n_digits = np.array(list(map(len, digits)))
        width = int(self.n_digits.max()) + 1
        self.digits = np.frombuffer(b"".join(d.ljust(width, b"\0") for d in digits), np.uint8).reshape(-1, width)
        self._clear()

    def _clear(self) -> None:
        self.memory: dict[bytes, int] = {}
        self.texts: list[bytes] = []
        self.sizes = np.zeros((0, 4), np.int64)
        self.first = np.zeros(0, np.int64)
        self.many = np.zeros(0, np.int64)
        self.codes = np.zeros(0, np.int64)
        self.times = np.zeros(0, np.int64)

    def _encode(self, texts: list[bytes]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of A and B for each text; None where bytes got lost."""
        plain = [t.decode() for t in texts]
        out = []
        left = self.a.encode_batch_fast([" " + p for p in plain], add_special_tokens=False)
        for text, a, b in zip(texts, left, self.b.encode(plain)):
            whole = b" " + text
            lossless = b"".join([self.bytes_a[x] for x in a.ids]) == whole == b"".join([self.bytes_b[y] for y in b])
            out.append((a.ids, b) if lossless else None)
        return out

    def _learn(self, parts: list[bytes]) -> list[int]:
        """Entries for new parts, each the bytes after its space; -1 where bytes got lost."""
        whole: list[list[bytes]] = []
        alone: list[bytes] = []
        size = JOINED
        for p in parts:
            if p[0] not in SURE or p[-1] == 32:
                alone.append(p)
                continue
            if size >= JOINED:
                whole.append([])
                size = 0
            whole[-1].append(p)
            size += len(p) + 1
        encoded = list(zip(whole, self._encode([b" ".join(w) for w in whole])))
        alone += [p for w, ids in encoded if ids is None for p in w]
        encoded = [x for x in encoded if x[1] is not None]
        encoded += [([p], ids) for p, ids in zip(alone, self._encode(alone)) if ids is not None]
        good = [p for w, _ in encoded for p in w]
        start = len(self.texts)
        if good:
            ids = [np.fromiter(chain.from_iterable(x[1][k] for x in encoded), np.int64) for k in range(2)]
            self._keep(*ids, np.cumsum([len(p) + 1 for p in good]))
        number = {p: start + k for k, p in enumerate(good)}
        return [number.get(p, -1) for p in parts]

    def _keep(self, a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> None:
        """Adds the parts that end at ``ends`` (in bytes) of the ids a and b to the memory."""
        at_a, at_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        cuts = np.intersect1d(at_a, at_b, assume_unique=True)
        edges_a, edges_b = (np.searchsorted(x, cuts, side="right") for x in (at_a, at_b))
        last = np.searchsorted(cuts, ends)  # each part's last group
        n_a, n_b = np.diff(edges_a, prepend=0), np.diff(edges_b, prepend=0)
        first_a, first_b = edges_a - n_a, edges_b - n_b
        part = np.searchsorted(ends, cuts)  # each group's part

        # Pairs of a group: all with all, of a long one by distinct ids.
        small = np.where(n_a * n_b <= LARGE_GROUP, n_a * n_b, 0)
        group = np.repeat(np.arange(len(cuts)), small)
        k = spread_out(np.zeros(len(cuts), np.int64), small)
        codes = a[first_a[group] + k // n_b[group]] * self.n_b + b[first_b[group] + k % n_b[group]]
        times, owner = np.ones(len(codes), np.int64), part[group]
        for g in np.flatnonzero(small == 0).tolist():
            x, m = np.unique(a[first_a[g] : edges_a[g]], return_counts=True)
            y, n = np.unique(b[first_b[g] : edges_b[g]], return_counts=True)
            codes = np.concatenate([codes, np.add.outer(x * self.n_b, y).ravel()])
            times = np.concatenate([times, np.multiply.outer(m, n).ravel()])
            owner = np.concatenate([owner, np.full(len(x) * len(y), part[g])])
        order = np.argsort(owner, kind="stable")
        many = np.bincount(owner, minlength=len(ends))
        first = len(self.codes) + np.cumsum(many) - many
        ordinal = last + 1
        sums = np.concatenate([[0], np.cumsum(n_a * n_b)])[ordinal]
        sizes = np.diff(np.stack([edges_a[last], edges_b[last], ordinal, sums], 1), axis=0, prepend=np.zeros((1, 4), np.int64))

        # Groups as text: A's ids, B's ids, each id's digits and the mark after it.
        group_a, group_b = np.repeat(np.arange(len(cuts)), n_a), np.repeat(np.arange(len(cuts)), n_b)
        place_a = np.arange(len(a)) + first_b[group_a]
        place_b = np.arange(len(b)) + edges_a[group_b]
        ids, marks = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), 44, np.uint8)
        ids[place_a], ids[place_b] = a, b
        marks[place_a[edges_a - 1]], marks[place_b[edges_b - 1]] = 124, 59
        letters = self.digits[ids]
        letters[np.arange(len(ids)), self.n_digits[ids]] = marks
        raw = letters[letters != 0].tobytes()
        stops = np.cumsum(self.n_digits[ids] + 1)[place_b[edges_b[last] - 1]].tolist()
        self.texts += [raw[x:y] for x, y in zip([0, *stops], stops)]
        self.codes, self.times = np.concatenate([self.codes, codes[order]]), np.concatenate([self.times, times[order]])
        self.first, self.many = np.concatenate([self.first, first]), np.concatenate([self.many, many])
        self.sizes = np.concatenate([self.sizes, sizes])

    def _part_numbers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Entry of each part of the texts (-1: bytes got lost), and how many parts each has."""
        if len(self.texts) > MOST_PARTS or len(self.codes) > 16 * MOST_PARTS:
            self._clear()
        parts, counts = [], []
        for text in texts:
            own = CUT.split(b" " + text)
            if own[0]:
                own[0] = own[0][1:]
            else:
                del own[0]
            parts += own
            counts.append(len(own))
        numbers = list(map(self.memory.get, parts))
        new = list({p: None for p, k in zip(parts, numbers) if k is None})
        if new:
            known = dict(zip(new, self._learn(new)))
            self.memory |= {p: k for p, k in known.items() if len(p) <= LONGEST_PART}
            numbers = [known[p] if k is None else k for p, k in zip(parts, numbers)]
        return np.array(numbers, np.int64), np.array(counts, np.int64)

    def align(self, texts: list[bytes | None]) -> list[tuple[list[int], bytes | None, np.ndarray, np.ndarray]]:
        """([n_a, n_b, n_groups, n_links], groups, pair codes in order, times each is linked) for each text.

        Groups are None for a text without tokens.
        """
        nothing = [0] * 4, None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        out: list[tuple] = [nothing] * len(texts)
        pieces = [(k, s) for k, t in enumerate(texts) if t for s in segments(t)]
        start = 0
        while start < len(pieces):
            stop, size = start, 0
            while stop < len(pieces) and (stop == start or size + len(pieces[stop][1]) <= SEGMENT):
                size += len(pieces[stop][1])
                stop += 1
            owners = [k for k, _ in pieces[start:stop]]
            for k, found in zip(owners, self._align([s for _, s in pieces[start:stop]])):
                if found is None:
                    out[k] = None
                elif out[k] is nothing:
                    out[k] = found
                elif out[k] is not None:  # a further segment of a long text
                    old = out[k]
                    sums = distinct_sums(*(np.concatenate([old[c], found[c]]) for c in (2, 3)))
                    out[k] = [x + y for x, y in zip(old[0], found[0])], old[1] + b";" + found[1], *sums
            start = stop
        return [nothing if x is None else x for x in out]

    def _align(self, texts: list[bytes]) -> list[tuple | None]:
        numbers, counts = self._part_numbers(texts)
        ends = np.cumsum(counts)
        owner = np.repeat(np.arange(len(texts)), counts)
        lost = np.zeros(len(texts), bool)
        lost[owner[numbers < 0]] = True
        known = np.maximum(numbers, 0) if len(self.texts) else numbers
        if lost.all():
            return [None] * len(texts)
        sizes = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.sizes[known], axis=0)])
        sizes = sizes[ends] - sizes[ends - counts]
        many = self.many[known]
        at = spread_out(self.first[known], many)
        codes, times = distinct_sums(np.repeat(owner, many) << 40 | self.codes[at], self.times[at])
        cuts = np.searchsorted(codes, np.arange(len(texts) + 1) << 40).tolist()
        codes &= (1 << 40) - 1
        names, places = self.texts, known.tolist()
        return [
            None if lost[k]
            else (sizes[k].tolist(), b"".join([names[j] for j in places[e - n : e]])[:-1], codes[a:b], times[a:b])
            for k, (n, e, a, b) in enumerate(zip(counts.tolist(), ends.tolist(), cuts[:-1], cuts[1:]))
        ]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(byte_level: str, pieces: str) -> Aligner:
    """The worker's aligner for two vocabulary files."""
    key = byte_level, pieces
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


def text_key(text: Column) -> Column:
    return F.coalesce(F.sha2(text, 256), F.lit(""))


def aligned_texts(texts: DataFrame, byte_level: str, pieces: str, keep_groups: bool = False) -> DataFrame:
    """(key, copies, four measures, groups_sha256, wide, codes, times) per row (text, copies) of ``texts``.

    ``codes`` are the linked id pairs as numbers ``a * size of B + b`` in order, ``times`` how often the
    text links each: little-endian numbers of 4 bytes, of 8 where ``wide``. ``keep_groups`` adds the groups as text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(byte_level, pieces)
        for batch in small_batches(batches, 4 << 20):
            rows = both.align([t.as_buffer().to_pybytes() if t.is_valid else None for t in batch.column(2)])
            wide = [both.kind.itemsize == 8 or (len(r[3]) > 0 and int(r[3].max()) >= 1 << 32) for r in rows]
            kinds = [np.dtype("<u8" if w else "<u4") for w in wide]
            columns = [batch.column(0), batch.column(1)]
            columns += [pa.array([r[0][k] for r in rows], pa.int64()) for k in range(4)]
            columns += [
                pa.array(["" if r[1] is None else hashlib.sha256(r[1]).hexdigest() for r in rows], pa.string()),
                pa.array(wide, pa.bool_()),
                pa.array([r[2].astype(k).tobytes() for r, k in zip(rows, kinds)], pa.binary()),
                pa.array([r[3].astype(k).tobytes() for r, k in zip(rows, kinds)], pa.binary()),
            ]
            if keep_groups:
                columns.append(pa.array([None if r[1] is None else r[1].decode() for r in rows], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["key", "copies", *MEASURES, "groups_sha256", "wide", "codes", "times"] + ["groups"] * keep_groups
    ship(texts.sparkSession)
    return texts.select(text_key(F.col("text")).alias("key"), "copies", F.col("text").cast("binary").alias("text")).mapInArrow(
        run,
        "key string, copies long, " + ", ".join(f"{m} long" for m in MEASURES)
        + ", groups_sha256 string, wide boolean, codes binary, times binary" + ", groups string" * keep_groups,
    )


def unpacked(batch: pa.RecordBatch, column: int) -> list[np.ndarray]:
    """A column of numbers; the batch's first column says which are wide."""
    wide = batch.column(0).to_pylist()
    return [np.frombuffer(x.as_buffer(), "<u8" if w else "<u4").astype(np.uint64) for w, x in zip(wide, batch.column(column))]


def pair_counts(texts: DataFrame, n_b: int) -> DataFrame:
    """(code, c, best): in how many documents each pair is linked, and whether no pair of its A id has more.

    Each task adds up what it reads, a text as often as it has copies, and gives out its sums whenever it
    holds two million pairs; Spark adds these. An A id has at most ``n_b`` pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merge() -> None:
            nonlocal codes, counts, size
            every = np.concatenate([codes, *[h[0] for h in held]])
            weight = np.concatenate([counts, *[h[1] for h in held]])
            codes, where = np.unique(every, return_inverse=True)
            counts = np.zeros(len(codes), np.int64)
            np.add.at(counts, where, weight)
            held.clear()
            size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(counts)], ["code", "c"])

        for batch in small_batches(batches):
            for found, copies in zip(unpacked(batch, 2), batch.column(1).to_pylist()):
                held.append((found, np.full(len(found), copies, np.int64)))
                size += len(found)
            if size > 1 << 21:
                merge()
                if len(codes) > 1 << 21:
                    yield flush()
                    codes, counts = codes[:0], counts[:0]
        merge()
        yield flush()

    parts = texts.select("wide", "copies", "codes").mapInArrow(run, "code long, c long")
    counted = parts.groupBy("code").agg(F.sum("c").alias("c"))
    top = F.max("c").over(W.partitionBy(F.floor(F.col("code") / n_b)))
    return counted.select("code", "c", (F.col("c") == top).alias("best"))


def slices(pairs: DataFrame, n_b: int, most: int) -> list[tuple[int, int]]:
    """Ranges of codes that hold at most ``most`` pairs each (or one A id's); as many rows as A ids are read."""
    per_id = pairs.groupBy(F.floor(F.col("code") / n_b).cast("long").alias("a")).agg(F.count(F.lit(1)).alias("n"))
    out, low, size = [], 0, 0
    for row in sorted(per_id.collect()):
        if size and size + row["n"] > most:
            out.append((low, row["a"] * n_b))
            low, size = row["a"] * n_b, 0
        size += row["n"]
    return [*out, (low, (1 << 63) - 1)]


def link_measures(texts: DataFrame, pairs: DataFrame, n_b: int, most: int = PAIRS_AT_ONCE) -> DataFrame:
    """(key, n_best, count_sum) per row of ``texts``, one pass for each slice of the pairs."""
    spark = texts.sparkSession
    found = None
    for low, high in slices(pairs, n_b, most):
        part = pairs.filter(F.col("code").between(low, high - 1)).sort("code").toArrow()
        known = spark.sparkContext.broadcast(
            tuple(part[c].to_numpy() for c in ("code", "c")) + (part["best"].to_numpy().astype(bool),)
        )

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            codes, counts, best = known.value
            for batch in small_batches(batches):
                own, times = unpacked(batch, 2), unpacked(batch, 3)
                sizes = np.array([len(x) for x in own])
                every = np.concatenate([*own, np.zeros(0, np.uint64)]).astype(np.int64)
                weight = np.concatenate([*times, np.zeros(0, np.uint64)]).astype(np.int64)
                at = np.searchsorted(codes, every)
                at[at == len(codes)] = 0
                here = codes[at] == every if len(codes) else np.zeros(len(every), bool)
                sums = np.zeros((2, len(every) + 1), np.int64)
                if len(codes):
                    np.cumsum(np.where(here & best[at], weight, 0), out=sums[0, 1:])
                    np.cumsum(np.where(here, weight * counts[at], 0), out=sums[1, 1:])
                ends = np.cumsum(sizes)
                each = sums[:, ends] - sums[:, ends - sizes]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1), pa.array(each[0]), pa.array(each[1])], ["key", "n_best", "count_sum"]
                )

        one = texts.select("wide", "key", "codes", "times").mapInArrow(run, "key string, n_best long, count_sum long")
        found = one if found is None else found.unionByName(one)
    return found.groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_tokenizers(
    docs: DataFrame, byte_level: str, pieces: str, doc_id: str = "doc_id", text: str = "text", most: int = PAIRS_AT_ONCE
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs``.

    A encodes a space and the text, B the text, to which it adds the space; special tokens in a text are
    plain text. Where tokens of both end, a group ends; ids of a group are linked, all with all. The count
    of a pair is the number of rows whose text links it.

    Rows are shuffled by full text and each distinct text is tokenised and aligned once; its pairs
    count as often as the text has copies, and its measures are joined to all rows with it. A text with
    very many copies is joined in as many tasks as it needs. Null and empty texts, and texts that
    either tokenizer changes, have no tokens: zeros and an empty digest. Repeated rows and rows
    that share a doc_id, or have none, each get their row. No rows give none; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    distinct = rows.groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    texts = settle(aligned_texts(distinct, byte_level, pieces), "aligned-texts")
    n_b = aligner(byte_level, pieces).n_b
    pairs = settle(pair_counts(texts, n_b), "pair-counts")
    total = texts.agg(F.sum("copies")).first()[0] or 0
    share = max(COPIES_A_TASK, total // COPIES_A_TASK)
    measures = texts.select("key", "copies", *MEASURES, "groups_sha256").join(link_measures(texts, pairs, n_b, most), "key")
    measures = measures.withColumn("tasks", F.ceil(F.col("copies") / share))
    #: At most total / share texts, so no more than COPIES_A_TASK rows.
    hot = texts.filter(F.col("copies") > share).select("key", F.ceil(F.col("copies") / share).alias("tasks"))
    slot = F.monotonically_increasing_id() % F.coalesce("tasks", F.lit(1))
    keyed = rows.select("doc_id", text_key(F.col("text")).alias("key"))
    dealt = keyed.join(F.broadcast(hot), "key", "left").select("doc_id", "key", slot.cast("long").alias("slot"))
    copied = measures.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)))
    return dealt.join(copied, ["key", "slot"]).select("doc_id", *MEASURES, "n_best", "count_sum", "groups_sha256")
