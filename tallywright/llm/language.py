"""Language identification by error-correcting output codes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.rows import ship, small_batches

DIM = 1 << 15
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
#: A text is ambiguous if the two nearest codewords differ by less than this share of their losses.
NEAR = 0.1
CHUNK = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
for _c in [*range(0, 65), *range(91, 97), *range(123, 128)]:
    _FOLD[_c] = 32


def buckets(text: str) -> Iterator[np.ndarray]:
    """Hash buckets of all byte trigrams and pairs, letters folded, other ASCII taken as blanks."""
    data = _FOLD[np.frombuffer((" " + text + "  ").encode(), np.uint8)]
    for start in range(0, len(data) - 2, CHUNK):
        b = data[start : start + CHUNK + 2].astype(np.uint32)
        pair = b[:-2] * np.uint32(256) + b[1:-1]
        for code in (pair * np.uint32(256) + b[2:], pair + np.uint32(1 << 24)):
            yield (code * np.uint32(2654435761)) >> np.uint32(17)


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 per class: every split of up to seven classes, else 16 log2(n) random
    balanced columns, the best of 50 draws by least distance between two classes."""
    if n <= 1:
        return np.zeros((n, 0), np.int64)
    if n <= 7:
        splits = [[1 if c == 0 or (s >> (c - 1)) & 1 else -1 for c in range(n)] for s in range((1 << max(n - 1, 0)) - 1)]
        return np.array(splits, np.int64).reshape(-1, n).T
    best, apart = None, -1
    bits = 16 * int(np.ceil(np.log2(n)))
    for draw in range(50):
        rng = np.random.default_rng([n, draw])
        code = np.array([rng.permutation(np.where(np.arange(n) % 2, 1, -1)) for _ in range(bits)]).T
        same = code @ code.T - 2 * bits * np.eye(n, dtype=np.int64)
        if (bits - int(same.max())) > apart:
            best, apart = code, bits - int(same.max())
    return best


@dataclass(frozen=True)
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray
    scale: float

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.code.shape[1]), 0
        for b in buckets(text):
            total += self.weights[b].sum(axis=0) if len(b) < DIM else np.bincount(b, minlength=DIM) @ self.weights
            n += len(b)
        return total / n

    def decide(self, margins: np.ndarray) -> tuple[str, float, bool]:
        """(language, score, ambiguous): the codeword with the least trust-weighted loss."""
        loss = (np.logaddexp(0, -self.scale * margins * self.code) * self.trust).sum(axis=1)
        order = np.argsort(loss, kind="stable")
        chance = np.exp(loss[order[0]] - loss)
        close = len(loss) > 1 and loss[order[1]] - loss[order[0]] < NEAR * loss[order[1]]
        return self.langs[order[0]], float(1 / chance.sum()), bool(close)


def held_out(doc_id: Column) -> Column:
    """True for the documents that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", alpha: float = 0.5) -> Model:
    """Binary n-gram classifiers, one per bit, from the counts of all learned documents.

    A bit's classifier weighs a bucket by the log ratio of its share in the languages whose codeword
    has the bit and in the others, so all of them follow from one table of language by bucket, added
    up in the tasks before it is shuffled: languages times 32,768 rows at most, whatever the input.
    Each learned document counts as the same mass. The trust in a bit is how far apart it keeps the
    languages' mean margins. Rows without id, language or letter teach nothing.
    """
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in small_batches(batches):
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not LETTER.search(content):
                    continue
                own = np.zeros(DIM)
                for b in buckets(content):
                    own += np.bincount(b, minlength=DIM)
                total[name] = total.get(name, 0) + np.round(own * (1e6 / own.sum()))
        for name, sums in total.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at)), pa.array(at), pa.array(sums[at].astype(np.int64))], ["lang", "bucket", "c"]
            )

    learned = docs.filter(F.col(doc_id).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(doc_id)))
    table = learned.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(
        count, "lang string, bucket long, c long"
    )
    rows = table.groupBy("lang", "bucket").agg(F.sum("c").alias("c")).toArrow()
    names = rows.column("lang").to_pylist()
    langs = sorted(set(names))
    counts = np.zeros((max(len(langs), 1), DIM))
    place = {name: k for k, name in enumerate(langs)}
    if langs:
        counts[[place[x] for x in names], rows.column("bucket").to_numpy()] = rows.column("c").to_numpy()
    code = codewords(len(langs))
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    least = alpha / DIM
    yes = np.stack([share[code[:, b] > 0].mean(axis=0) for b in range(code.shape[1])], axis=1) if code.size else np.zeros((DIM, 0))
    no = np.stack([share[code[:, b] < 0].mean(axis=0) for b in range(code.shape[1])], axis=1) if code.size else yes
    weights = np.log(yes + least) - np.log(no + least)
    gap = (share @ weights) * code if code.size else np.zeros((1, 0))
    trust = np.maximum(gap.min(axis=0), 0) + 1e-3
    scale = 4 / max(float(gap.mean()), 1e-9) if gap.size else 1.0
    return Model(langs, code, weights, trust / trust.mean() if trust.size else trust, scale)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) for every row, from its whole text alone.

    ``und`` with score 0 for null texts, texts without a letter, and an empty model. Repeated rows
    get equal results; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in small_batches(batches):
            found = [
                own.decide(own.margins(t)) if own.langs and t and LETTER.search(t) else (UNKNOWN, 0.0, False)
                for t in batch.column(2).to_pylist()
            ]
            columns = [pa.array(c, k) for c, k in zip(zip(*found), (pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *columns], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"]
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
