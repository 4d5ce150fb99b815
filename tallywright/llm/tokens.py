"""Token ids of whole texts by a public tokenizer that drops white space.

Such a tokenizer's result for a text is the joined result for its words, so each distinct word is
encoded once per worker and found again by hash: a few array operations per batch.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.rows import ship, small_batches

CHUNK = 1 << 20
MARK = "\x01"

_rng = np.random.default_rng(7)
_MIX = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[65:91] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class WordEncoder:
    """Ids of texts, word by word, with a memory of at most ``most_words`` words."""

    def __init__(self, path: str, most_words: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most_words
        self.mark = self._encode(MARK)
        probe = f"Ab, cd.\n{MARK} e"
        if len(self.mark) != 1 or self._encode(probe) != sum(map(self._encode, ["Ab", ",", "cd", ".", MARK, "e"]), []):
            raise ValueError("this tokenizer doesn't work word by word")
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self._clear()
        self._grow(1 << 16)

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _clear(self) -> None:
        self.slots = 1 << (2 * self.most - 1).bit_length()
        self.keys = np.zeros(self.slots, np.uint64)
        self.vals = np.zeros(self.slots, np.int32)
        self.n = self.used = 0
        self.pool = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 12, np.int64)
        self.count = np.zeros(1 << 12, np.int64)

    def _grow(self, n: int) -> None:
        self.power = _powers(_BASE, n)
        self.inverse = _powers(pow(_BASE, -1, 1 << 64), n)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Number of each word, -1 where it isn't known."""
        slot = (h >> np.uint64(20)).astype(np.int64) & (self.slots - 1)
        found = self.keys[slot]
        out = np.where(found == h, self.vals[slot], np.int32(-1))
        left = np.flatnonzero((found != h) & (found != 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (self.slots - 1)
            found = self.keys[slot]
            hit = found == h[left]
            out[left[hit]] = self.vals[slot[hit]]
            go = ~hit & (found != 0)
            left, slot = left[go], slot[go]
        return out

    def _add(self, h: np.ndarray, words: list[bytes]) -> None:
        texts = [w.decode() for w in words]
        plain = [MARK not in t for t in texts]
        joined = f" {MARK} ".join(t for t, p in zip(texts, plain) if p)
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(ids == self.mark[0])
        parts = iter(np.split(ids, cuts))
        each = []
        for k, (t, p) in enumerate(zip(texts, plain)):
            part = next(parts) if p else np.array(self._encode(t), np.uint32)
            each.append(part[1:] if p and len(part) and part[0] == self.mark[0] else part)
        sizes = np.array([len(x) for x in each], np.int64)
        total, m = int(sizes.sum()), len(words)
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.n + m > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        self.pool[self.used : self.used + total] = np.concatenate(each)
        self.begin[self.n : self.n + m] = self.used + np.cumsum(sizes) - sizes
        self.count[self.n : self.n + m] = sizes
        number = np.arange(self.n, self.n + m, dtype=np.int32)
        self.used, self.n = self.used + total, self.n + m
        slot = (h >> np.uint64(20)).astype(np.int64) & (self.slots - 1)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            won = self.keys[slot] == h
            self.vals[slot[won]] = number[won]
            h, number, slot = h[~won], number[~won], (slot[~won] + 1) & (self.slots - 1)

    def _batch(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after the other, and where each piece begins (and the last ends)."""
        blob = b" ".join(pieces) + b" "
        data = np.frombuffer(blob, np.uint8)
        if b"<|" not in blob:  # else lower-casing could make a special token
            data = _LOWER[data]
        n = len(data)
        if n > len(self.power):
            self._grow(n)
        blank = _BLANK[data]
        starts, ends = ~blank, ~blank
        starts[1:] &= blank[:-1]
        ends[:-1] &= blank[1:]
        stop = (data == 46) | (data == 44)
        if n > 2:
            cut = np.flatnonzero(stop[1:-1] & _LETTER[data[:-2]] & blank[2:]) + 1
            starts[cut] = True
            ends[cut - 1] = True
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_MIX[data] * self.power[:n], out=total[1:])
        h = (total[ends] - total[starts]) * self.inverse[starts]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (ends - starts).astype(np.uint64)
        h |= np.uint64(1)
        word = self._find(h)
        new = np.flatnonzero(word < 0)
        if len(new):
            _, first = np.unique(h[new], return_index=True)
            first = new[first]
            if self.n + len(first) > self.most or self.used > 16 * self.most:
                self._clear()
                _, first = np.unique(h, return_index=True)
            raw = data.tobytes()
            self._add(h[first], [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())])
            word = self._find(h)
        sizes = self.count[word]
        after = np.cumsum(sizes)
        ids = self.pool[np.arange(after[-1] if len(after) else 0) + np.repeat(self.begin[word] - after + sizes, sizes)]
        edges = np.cumsum([0] + [len(p) + 1 for p in pieces])
        return ids, np.concatenate([[0], after])[np.searchsorted(starts, edges)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null is empty. Long texts are cut at blanks for the work, not in the result."""
        pieces, owner = [], []
        for k, text in enumerate(texts):
            data = (text or "").encode()
            while len(data) > CHUNK:
                at = max(data.rfind(c, 0, CHUNK) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
                if at <= 0:
                    ends = [x for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (x := data.find(c, CHUNK)) > 0]
                    if not ends:
                        break
                    at = min(ends)
                pieces.append(data[:at])
                owner.append(k)
                data = data[at:]
            pieces.append(data)
            owner.append(k)
        out: list[list[np.ndarray]] = [[] for _ in texts]
        start = 0
        while start < len(pieces):
            stop, size = start, 0
            while stop < len(pieces) and (stop == start or size + len(pieces[stop]) <= CHUNK):
                size += len(pieces[stop])
                stop += 1
            ids, edges = self._batch(pieces[start:stop])
            for k, a, b in zip(owner[start:stop], edges[:-1].tolist(), edges[1:].tolist()):
                out[k].append(ids[a:b])
            start = stop
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def id_type(width: int) -> np.dtype:
    return np.dtype("<u2" if width == 2 else "<u4")


def tokenise(docs: DataFrame, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, width, lead, ids) for every row: ids as little-endian numbers of ``width`` bytes.

    ``end_id`` closes each document, so null and blank texts have one id. ``lead`` is the largest id
    of the text, -1 without any: merges are numbered by frequency, so it is the text's rarest unit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in small_batches(batches, 4 << 20):
            each = words.encode(batch.column(1).to_pylist())
            kind = id_type(words.width)
            end = np.array([end_id], kind).tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) + 1 for x in each], pa.int64()),
                    pa.array([words.width] * len(each), pa.int32()),
                    pa.array([int(x.max()) if len(x) else -1 for x in each], pa.int64()),
                    pa.array([x.astype(kind).tobytes() + end for x in each], pa.binary()),
                ],
                ["doc_id", "n", "width", "lead", "ids"],
            )

    ship(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n long, width int, lead long, ids binary"
    )


def id_counts(tokens: DataFrame, in_documents: bool = False) -> dict[int, int]:
    """How often each id occurs (or in how many rows), over all rows; as many entries as ids exist."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in small_batches(batches):
            for width, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(raw.as_buffer(), id_type(width))
                top = int(ids.max()) + 1
                if top > len(total):
                    total = np.concatenate([total, np.zeros(top - len(total), np.int64)])
                if in_documents:
                    seen = np.zeros(top, bool)
                    seen[ids] = True
                    total[:top] += seen
                else:
                    part = np.bincount(ids)
                    total[: len(part)] += part
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "c"])

    ship(tokens.sparkSession)
    counted = tokens.select("width", "ids").mapInArrow(run, "id long, c long")
    return {r["id"]: r["c"] for r in counted.groupBy("id").agg(F.sum("c").alias("c")).collect()}
