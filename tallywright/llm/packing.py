"""Lexical retrieval packing: BM25 neighbours of a seed document fill its window."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tallywright.llm.rows import small_batches
from tallywright.llm.tokens import id_counts, id_type

WINDOW = 2048
SHARD_IDS = 1 << 20
QUERY_TERMS = 24
K1, B = 1.2, 0.75


class Shard:
    """An inverted index over the open pieces of a shard, and their packing into windows."""

    def __init__(self, pieces: list[tuple], idf: np.ndarray, mean: float, window: int):
        #: Piece: [doc_id, start, ids, doc_tokens]; ids shorter than the window.
        self.pieces, self.idf, self.window = pieces, idf, window
        m = len(pieces)
        sizes = np.array([len(p[2]) for p in pieces], np.int64)
        term = np.concatenate([p[2] for p in pieces]).astype(np.int64)
        codes = np.sort(term * m + np.repeat(np.arange(m), sizes))
        first = np.flatnonzero(np.diff(codes, prepend=-1))
        tf = np.diff(first, append=len(codes))
        term, self.doc = codes[first] // m, codes[first] % m
        norm = tf + K1 * (1 - B + B * sizes[self.doc] / mean)
        self.impact = idf[term] * tf * (K1 + 1) / norm
        edge = np.flatnonzero(np.diff(term, prepend=-1))
        self.begin = np.zeros(len(idf) + 1, np.int64)
        self.end = np.zeros(len(idf) + 1, np.int64)
        self.begin[term[edge]], self.end[term[edge]] = edge, np.append(edge[1:], len(term))
        self.open = np.ones(m, bool)

    def neighbours(self, seed: int) -> np.ndarray:
        """Open pieces that share one of the seed's rarest terms, best score first."""
        terms = np.unique(self.pieces[seed][2])
        terms = terms[self.end[terms] - self.begin[terms] > 1]
        if len(terms) > QUERY_TERMS:
            terms = terms[np.argpartition(-self.idf[terms], QUERY_TERMS)[:QUERY_TERMS]]
        spans = [slice(a, b) for a, b in zip(self.begin[terms].tolist(), self.end[terms].tolist())]
        if not spans:
            return np.zeros(0, np.int64)
        docs = np.concatenate([self.doc[s] for s in spans])
        score = np.bincount(docs, np.concatenate([self.impact[s] for s in spans]), len(self.pieces))
        score[~self.open] = 0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]

    def windows(self) -> Iterator[list[tuple]]:
        """Full windows of pieces; the last one may be short. Every id goes to one window."""
        for seed in range(len(self.pieces)):
            while self.open[seed]:
                out, room = [self._take(seed, self.window)], self.window
                room -= len(out[0][2])
                cut: list[int] = []
                if room:
                    for d in self.neighbours(seed).tolist():
                        if len(self.pieces[d][2]) <= room:
                            out.append(self._take(d, room))
                            room -= len(out[-1][2])
                            if not room:
                                break
                        else:
                            cut.append(d)
                near = iter(cut)
                rest = seed
                while room:
                    d = next(near, None)
                    if d is None:
                        while rest < len(self.pieces) and not self.open[rest]:
                            rest += 1
                        if rest == len(self.pieces):
                            break
                        d = rest
                    out.append(self._take(d, room))
                    room -= len(out[-1][2])
                yield out

    def _take(self, d: int, room: int) -> tuple:
        doc, start, ids, total = self.pieces[d]
        if len(ids) <= room:
            self.open[d] = False
            return doc, start, ids, total
        self.pieces[d] = (doc, start + room, ids[room:], total)
        return doc, start, ids[:room], total


PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def pack(
    tokens: DataFrame, window: int = WINDOW, keep_ids: bool = False, shard_ids: int = SHARD_IDS
) -> DataFrame:
    """Pieces of all rows of ``tokens`` (a written table of :func:`tokens.tokenise`) in sequences.

    A document's full windows are sequences of their own; its rest is open. Rows are sorted by
    ``lead``, the rarest unit, which brings texts with common rare words together, then by doc_id,
    so that a frequent unit spans as many tasks as it needs. Each task cuts its rows into shards of
    about 2^20 ids, indexes a shard and fills windows: the next open piece is the seed, its BM25
    neighbours that fit follow, best first, and the best one that doesn't fit is cut to close the
    window. A shard's unfinished window passes to the task's next shard, so a task has one short
    sequence at most. Document frequencies are counted over all rows; there are as many as ids.
    Rows are packed as they come: a repeated row or doc_id is a document of its own. No rows give none.
    """
    spark = tokens.sparkSession
    df = id_counts(tokens, in_documents=True)
    n = max(df.values(), default=0)  # every document has the end id
    size = max(df, default=0) + 1
    freq = np.zeros(size)
    freq[list(df)] = list(df.values())
    total = tokens.groupBy().sum("n").first()[0] or 0
    known = spark.sparkContext.broadcast((np.log1p((n - freq + 0.5) / (freq + 0.5)), max(1.0, total / max(1, n))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, mean = known.value
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def put(pieces: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, ids, doc_tokens in pieces:
                raw = ids.astype("<u4").tobytes()
                row = (doc, start, len(ids), zlib.crc32(raw), doc_tokens, sequence, offset)
                rows.append((*row, raw) if keep_ids else row)
                offset += len(ids)
            sequence += 1

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.binary()] * keep_ids
            names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * keep_ids
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        def fill(pieces: list[tuple]) -> list[tuple]:
            """Packs the pieces; returns those of a short last window."""
            for out in Shard(pieces, idf, mean, window).windows():
                if sum(len(p[2]) for p in out) < window:
                    return out
                put(out)
            return []

        open_pieces: list[tuple] = []
        size = 0
        for batch in small_batches(batches):
            for doc, width, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids = np.frombuffer(raw.as_py(), id_type(width))
                whole = len(ids) // window * window
                for at in range(0, whole, window):
                    put([(doc, at, ids[at : at + window], len(ids))])
                if whole < len(ids):
                    open_pieces.append((doc, whole, ids[whole:], len(ids)))
                    size += len(ids) - whole
                if size >= shard_ids:
                    open_pieces = fill(open_pieces)
                    size = sum(len(p[2]) for p in open_pieces)
                if len(rows) >= 4096:
                    yield flush()
        if open_pieces and (last := fill(open_pieces)):
            put(last)
        if rows:
            yield flush()

    ordered = (
        tokens.select("doc_id", "width", "ids", "lead")
        .repartitionByRange("lead", "doc_id").sortWithinPartitions("lead", "doc_id")
    )
    return ordered.select("doc_id", "width", "ids").mapInArrow(run, PIECES + ", ids binary" * keep_ids)
