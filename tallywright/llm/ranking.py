"""Ranked lexical search: item bundles pass through the owners of their terms and gather scores."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywright.llm.decontamination import words_of
from tallywright.llm.rows import ship, small_batches
from tallywright.workspace import settle

TOP = 10
#: Term owners, one stage each.
STAGES = 4
#: Items of a bundle, items and bytes of items searched at once; more items take more passes.
BUNDLE, ITEMS_AT_ONCE, BYTES_AT_ONCE = 64, 1024, 1 << 24
#: Accumulators, and postings, that a block of documents may have at most on average.
ENTRIES = 1 << 21
#: No term adds more than its weight times this.
MOST_IMPACT = 1_000_000
LAST = np.iinfo(np.int64).max

BUNDLES = "block long, bundle int, items binary, rows binary, ids binary, scores binary"
FOUND = "item int, row long, score long, id long"


def document_weight(n: Column, n_docs: int, n_terms: int) -> Column:
    """100 - 75 + ((75 * n * N) div L): longer texts than the mean get a larger divisor."""
    return F.expr(f"25 + (75L * n * {n_docs}L) div {max(1, n_terms)}L")


def term_weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """(row, doc_id, n, terms, tfs) for every row: number of all its terms, its known terms and how often each occurs."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = known.value.get
        for batch in small_batches(batches):
            sizes, terms, tfs = [], [], []
            for value in batch.column(2):
                words = words_of(value.as_buffer().to_pybytes()) if value.is_valid else []
                ids = np.fromiter(map(find, words, repeat(-1)), np.int32, len(words))
                own, often = np.unique(ids[ids >= 0], return_counts=True)
                sizes.append(len(words))
                terms.append(own)
                tfs.append(often)
            ends = pa.array(np.cumsum([0, *map(len, terms)]), pa.int32())
            none = [np.zeros(0, np.int32)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(np.concatenate(terms + none), pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(np.concatenate(tfs + none), pa.int64())),
                ],
                ["row", "doc_id", "n", "terms", "tfs"],
            )

    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(text).cast("binary").alias("text"),
    ).mapInArrow(run, "row long, doc_id long, n long, terms array<int>, tfs array<long>")


class Plan:
    """Items' terms in order of weight, cut into stages of about equal numbers of postings.

    Terms are numbered by place in this order. ``rest[s]`` bounds what an item can still gain after stage s.
    """

    def __init__(self, items: list[list[int]], df: dict[int, tuple[int, int]], n_docs: int, stages: int = STAGES):
        order = sorted(df, key=lambda t: (df[t][0], t))
        self.place = np.full(max(df, default=-1) + 2, -1, np.int64)
        self.place[order] = np.arange(len(order))
        after = np.cumsum([df[t][0] for t in order]) if order else np.zeros(0)
        total = after[-1] if order else 0
        cuts = [int(np.searchsorted(after, total * (s + 1) / stages - 0.5)) + 1 for s in range(stages - 1)]
        self.edges = np.array([0, *[min(c, len(order)) for c in cuts], len(order)])
        #: For each item: (place, weight times repeats) in order of place.
        self.terms: list[list[tuple[int, int]]] = []
        self.rest = np.zeros((stages, len(items)), np.int64)
        weight = {t: term_weight(df[t][0], n_docs) for t in df}
        for k, own in enumerate(items):
            found: dict[int, int] = {}
            for t in own:
                if t in df:
                    found[int(self.place[t])] = found.get(int(self.place[t]), 0) + weight[t]
            self.terms.append(sorted(found.items()))
            for at, w in self.terms[-1]:
                stage = int(np.searchsorted(self.edges, at, side="right")) - 1
                self.rest[:stage, k] += w * df[order[at]][1]

    def owned(self, stage: int) -> list[list[tuple[int, int]]]:
        low, high = self.edges[stage], self.edges[stage + 1]
        return [[(at, w) for at, w in own if low <= at < high] for own in self.terms]


def numbers(raw, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), kind)


def owner_postings(counts: DataFrame, plan: Plan, stage: int, n_blocks: int, m: Column) -> DataFrame:
    """(block, row, doc_id, terms, impacts) of documents with a term of the stage: what its owner holds."""
    place, low, high = plan.place, plan.edges[stage], plan.edges[stage + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            terms, tfs = batch.column(4), batch.column(5)
            ends = terms.offsets.to_numpy()
            at = place[terms.flatten().to_numpy()]
            tf = tfs.flatten().to_numpy()
            doc = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            impact = (1_000_000_000 * tf) // (1000 * tf + 8 * batch.column(3).to_numpy()[doc])
            own = (at >= low) & (at < high)
            at, impact, doc = at[own].astype("<i4"), impact[own].astype("<i4"), doc[own]
            here = np.unique(doc)
            cuts = np.searchsorted(doc, [*here, batch.num_rows])
            raw = [(at[a:b].tobytes(), impact[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
            taken = pa.array(here)
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).take(taken) for k in range(3)]
                + [pa.array([r[k] for r in raw], pa.binary()) for k in range(2)],
                ["block", "row", "doc_id", "terms", "impacts"],
            )

    block = F.pmod(F.xxhash64("row"), F.lit(n_blocks)).alias("block")
    wanted = counts.filter(F.size("terms") > 0).select(block, "row", "doc_id", m.alias("m"), "terms", "tfs")
    return wanted.mapInArrow(run, "block long, row long, doc_id long, terms binary, impacts binary")


def adder(owned, rest: np.ndarray, top: int, last: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    return lambda bundles, postings: add_stage(bundles, postings, owned, rest, top, last)


def add_stage(bundles: pa.Table, postings: pa.Table, owned, rest: np.ndarray, top: int, last: bool) -> pa.Table:
    """Accumulators of one block with a stage's contributions; in the last stage the block's best documents.

    An accumulator is dropped when all that its item can still gain doesn't lift it to the score of the
    ``top``-th best document so far: that many documents of this very block will be ahead of it. A dropped
    document that meets a later term begins again below them, so it is never chosen.
    """
    block = bundles["block"][0] if bundles.num_rows else postings["block"][0]
    held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for items, rows, ids, scores in zip(*(bundles[c] for c in ("items", "rows", "ids", "scores"))):
        item, each = numbers(items, "<i4"), [numbers(x) for x in (rows, ids, scores)]
        cuts = np.flatnonzero(np.diff(item, prepend=-1, append=-1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            held[int(item[a])] = tuple(x[a:b] for x in each)
    own_rows = postings["row"].to_numpy()
    own_ids = postings["doc_id"].fill_null(LAST).to_numpy()
    every = np.concatenate([own_rows, *[h[0] for h in held.values()]])
    docs, first = np.unique(every, return_index=True)
    ids = np.concatenate([own_ids, *[h[1] for h in held.values()]])[first]
    terms = [numbers(x, "<i4") for x in postings["terms"]]
    none = np.zeros(0, np.int32)
    term, impact = np.concatenate([*terms, none]), np.concatenate([*[numbers(x, "<i4") for x in postings["impacts"]], none])
    doc = np.repeat(np.searchsorted(docs, own_rows), np.array([len(x) for x in terms], np.int64))
    order = np.argsort(term, kind="stable")
    term, impact, doc = term[order], impact[order].astype(np.int64), doc[order]
    out: list[tuple[int, np.ndarray, np.ndarray]] = []
    score = np.zeros(len(docs), np.int64)
    for item, own in enumerate(owned):
        if item in held:
            score[np.searchsorted(docs, held[item][0])] = held[item][2]
        for at, weight in own:
            a, b = np.searchsorted(term, [at, at + 1])
            score[doc[a:b]] += weight * impact[a:b]
        met = np.flatnonzero(score)
        got = score[met]
        score[met] = 0
        if len(met) > top:
            if last:
                best = np.lexsort((docs[met], ids[met], -got))[:top]
                met, got = met[best], got[best]
            else:
                least = np.partition(got, len(got) - top)[len(got) - top]
                keep = got + rest[item] >= least
                met, got = met[keep], got[keep]
        if len(met):
            out.append((item, met, got))
    if last:
        item = np.repeat([o[0] for o in out], [len(o[1]) for o in out]).astype(np.int32)
        met = np.concatenate([o[1] for o in out] + [none])
        got = np.concatenate([o[2] for o in out] + [np.zeros(0, np.int64)])
        return pa.table({"item": pa.array(item), "row": docs[met], "score": got, "id": ids[met]})
    rows = []
    for bundle in sorted({o[0] // BUNDLE for o in out}):
        mine = [o for o in out if o[0] // BUNDLE == bundle]
        item = np.repeat([o[0] for o in mine], [len(o[1]) for o in mine]).astype("<i4")
        met, got = (np.concatenate([o[k] for o in mine]) for k in (1, 2))
        rows.append((block.as_py(), bundle, item.tobytes(), docs[met].tobytes(), ids[met].tobytes(), got.tobytes()))
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
    columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
    return pa.Table.from_arrays(columns, ["block", "bundle", "items", "rows", "ids", "scores"])


def parts_of(items: DataFrame) -> list[DataFrame]:
    """The items in parts that may be read by the driver."""
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    n = max(1, -(-size["n"] // ITEMS_AT_ONCE), -(-(size["b"] or 0) // BYTES_AT_ONCE))
    if n == 1:
        return [items]
    numbered = settle(items.withColumn("part", F.monotonically_increasing_id()), "numbered-items")
    return [numbered.filter(F.pmod(F.xxhash64("part"), F.lit(n)) == k).drop("part") for k in range(n)]


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    top: int = TOP,
    stages: int = STAGES,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents with a score above 0 for each row of ``items``.

    All arithmetic on scores is in 64-bit integers, so the order in which they are added doesn't matter.
    The terms of all items are dealt to ``stages`` owners, rarest first, about as many postings each; the
    documents to blocks of bounded size. A bundle of items carries its accumulators of a block's documents
    from owner to owner, by a cogroup with the owner's postings for that block, and drops those that can't
    come among the block's best any more, which is exact. Blocks give their best documents, one window
    over these the result.

    Items are read by the driver in parts of at most about 1,024 rows and 16 MB, and each part takes a
    pass. Null, empty and blank texts have no terms: they aren't counted as documents and no item
    without terms gets rows. Equal scores go by doc_id (none last), then by place in the table. Repeated
    rows, and rows that share an id, are documents, or items, of their own. Empty tables give no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    known = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    kind = known.schema["item_id"].dataType.simpleString()
    found = None
    for part in parts_of(known):
        read = [(r["item_id"], words_of(None if r["text"] is None else r["text"].encode())) for r in part.collect()]
        vocabulary = {w: k for k, w in enumerate(sorted({w for _, own in read for w in own}))}
        counts = settle(term_counts(docs, vocabulary, doc_id, text), "term-counts")
        sizes = counts.agg(
            F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms"), F.sum(F.size("terms")).alias("postings")
        ).first()
        n_docs, n_terms = sizes["docs"], sizes["terms"] or 0
        m = document_weight(F.col("n"), n_docs, n_terms)
        held = counts.select(m.alias("m"), F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("m", "x.*")
        impact = F.expr("(1000000000L * tfs) div (1000L * tfs + 8L * m)")
        df = {
            r["terms"]: (r["df"], r["most"])
            for r in held.groupBy("terms").agg(F.count(F.lit(1)).alias("df"), F.max(impact).alias("most")).collect()
        }
        plan = Plan([[vocabulary[w] for w in own] for _, own in read], df, n_docs, stages)
        n_blocks = max(1, -(-n_docs * len(read) // ENTRIES), -(-(sizes["postings"] or 0) // ENTRIES))
        state = spark.createDataFrame([], BUNDLES)
        for stage in range(stages):
            last = stage == stages - 1
            add = adder(plan.owned(stage), plan.rest[stage], top, last)
            postings = owner_postings(counts, plan, stage, n_blocks, m)
            state = state.groupBy("block").cogroup(postings.groupBy("block")).applyInArrow(add, FOUND if last else BUNDLES)
        place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), "id", "row"))
        best = state.withColumn("rank", place).filter(F.col("rank") <= top)
        names = spark.createDataFrame([(k, r[0]) for k, r in enumerate(read)], f"item int, item_id {kind}")
        one = (
            counts.select("row", "doc_id")
            .join(F.broadcast(best), "row")  # at most ``top`` rows an item
            .join(F.broadcast(names), "item")
            .select("item_id", "rank", "doc_id", "score")
        )
        found = one if found is None else found.unionByName(one)
    return found
