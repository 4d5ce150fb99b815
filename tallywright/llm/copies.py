"""Near copies by Jaccard similarity of word shingles: an exact prefix filter finds pairs, hash sets judge them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm import simhash
from tallywright.llm.graph import components, star_round
from tallywright.llm.rows import ship, small_batches
from tallywright.workspace import settle

SHINGLE = 5
#: Similarity as a fraction, compared in whole numbers.
LEAST = (4, 5)
#: Common shingles that all tasks know, at most (20 bytes each); rarer ones have no order but that of their hash.
MOST_COMMON = 1 << 21
#: Parts of the hash range that are counted apart; bits of the map of shingles that occur twice, by hash.
RANGES, MAP_BITS = 10, 27
#: Hashes a task holds back to merge repeats before they are shuffled; texts worked through at once, in bytes.
HELD, AT_ONCE = 1 << 20, 1 << 20
#: 64-bit words of a set's sketch.
SKETCH = 8

#: All pairs left are judged when those that may be alike are at most so many for each entry, or when a turn of
#: WIDEST questions a shingle, as wide as the one before, has connected fewer than one in USEFUL of them.
ALL_PAIRS, WIDEST, USEFUL = 4, 16, 10

_rng = np.random.default_rng(42)
_LETTER = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _STEP, _LAST = (int(x) | 1 for x in _rng.integers(1 << 62, 1 << 63, 3, dtype=np.uint64))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(_LAST)
    return h ^ (h >> np.uint64(29))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ``data`` begin, and a hash of each: a polynomial over its bytes, mixed."""
    blank = _BLANK[data]
    starts, ends = ~blank, ~blank
    starts[1:] &= blank[:-1]
    ends[:-1] &= blank[1:]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    sizes = ends - starts
    out = np.zeros(len(starts), np.uint64)
    # Words of one length together: as many steps as it has bytes, whatever the text.
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order], prepend=0, append=0))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        which = order[a:b]
        at, h = starts[which], np.full(b - a, int(sizes[which[0]]), np.uint64)
        for k in range(int(sizes[which[0]])):
            h = h * np.uint64(_BASE) + _LETTER[data[at + k]]
        out[which] = h
    return starts, _mixed(out)


def shingle_sets(texts: list[bytes | None], width: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes.

    Words are those of :func:`simhash.fingerprint`. A text of fewer words than ``width`` is one shingle,
    one without words has none.
    """
    none = np.zeros(0, np.uint64)
    out = [none] * len(texts)
    lower = [(t or b"").lower() for t in texts]
    start = 0
    while start < len(lower):
        stop, size = start, 0
        while stop < len(lower) and (stop == start or size + len(lower[stop]) <= AT_ONCE):
            size += len(lower[stop]) + 1
            stop += 1
        edges = np.cumsum([0] + [len(t) + 1 for t in lower[start:stop]])
        begins, word = word_hashes(np.frombuffer(b"\n".join(lower[start:stop]) + b"\n", np.uint8))
        grams = word[: max(0, len(word) - width + 1)].copy()
        for k in range(1, width):
            grams = grams * np.uint64(_STEP) + word[k : k + len(grams)]
        grams = _mixed(grams)
        cuts = np.searchsorted(begins, edges).tolist()
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if b - a >= width:
                out[start + k] = np.unique(grams[a : b - width + 1])
            elif b > a:
                h = np.full(1, b - a, np.uint64)
                for w in word[a:b]:
                    h = h * np.uint64(_STEP) + w
                out[start + k] = _mixed(h)
        start = stop
    return out


def alike(both: int, a: int, b: int) -> bool:
    """Whether sets of sizes a and b with ``both`` common elements are as similar as :data:`LEAST`."""
    return LEAST[1] * both >= LEAST[0] * (a + b - both)


def sketch(own: np.ndarray) -> np.ndarray:
    """A bit for each of 512 places that an odd number of the set's hashes fall on, as signed 64-bit numbers.

    Sets differ in at least as many elements as their sketches differ in bits.
    """
    odd = np.bincount((own & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(bool)).view("<i8")


def raw_texts(column: pa.Array) -> list[bytes | None]:
    return [t.as_buffer().to_pybytes() if t.is_valid else None for t in column]


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, key, row) of rows with an id: ``key`` tells apart rows that share it and differ in any column."""
    others = F.to_json(F.struct(F.lit(0).alias("-"), *[F.col(f"`{c}`") for c in docs.columns if c != text]))
    return docs.filter(F.col(f"`{doc_id}`").isNotNull()).select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.xxhash64(F.col(f"`{text}`"), others).alias("key"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )


def once(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """Each (doc_id, key) once; only rows of the keys in ``repeated`` need a shuffle for that."""
    names = ["doc_id", "key"]
    return rows.join(repeated, names, "left_anti").unionByName(
        rows.join(repeated, names, "left_semi").dropDuplicates(names)
    )


def text_forms(rows: DataFrame) -> DataFrame:
    """(doc_id, key, form): ``form`` is a 128-bit digest of the words in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            forms = [xxhash.xxh3_128_digest(b" ".join((t or b"").lower().split())) for t in raw_texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(forms, pa.binary())], ["doc_id", "key", "form"])

    ship(rows.sparkSession)
    return rows.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key long, form binary")


def shingle_ranges(texts: DataFrame, map_bits: int = MAP_BITS) -> DataFrame:
    """(part, twice, hashes, counts, classes), a row per range of hashes, with all shingles counted exactly.

    ``twice`` has a bit for each place of the range that holds a shingle of two texts or more; ``hashes``
    and ``counts`` are the shingles of over two texts, ``classes`` says how many are in 2^k texts or
    more. Tasks merge a million hashes before they send them: eight bytes a shingle, and less for repeats.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[np.ndarray]) -> pa.RecordBatch:
            hashes, counts = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(hashes, np.arange(1 << RANGES, dtype=np.uint64) << np.uint64(64 - RANGES))
            rows = [
                (k, hashes[a:b].tobytes(), counts[a:b].astype("<u4").tobytes())
                for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(hashes)])) if b > a
            ]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))],
                ["part", "hashes", "counts"],
            )

        held, size = [], 0
        for batch in small_batches(batches):
            for own in shingle_sets(raw_texts(batch.column(0))):
                held.append(own)
                size += len(own)
                if size >= HELD:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    def count(rows: pa.Table) -> pa.Table:
        hashes = np.concatenate([np.frombuffer(x.as_buffer(), "<u8") for x in rows["hashes"]])
        counts = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in rows["counts"]]).astype(np.int64)
        order = np.argsort(hashes)
        hashes = hashes[order]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        counts, hashes = np.add.reduceat(counts[order], first), hashes[first]
        bits = np.zeros(1 << (map_bits - RANGES), bool)
        places = (hashes[counts > 1] >> np.uint64(64 - map_bits)).astype(np.int64)
        bits[places & (len(bits) - 1)] = True
        classes = [int((counts >= 1 << k).sum()) for k in range(40)]
        common = counts > 2
        return pa.table(
            {
                "part": rows["part"][:1],
                "twice": pa.array([np.packbits(bits).tobytes()], pa.binary()),
                "hashes": pa.array([hashes[common].tobytes()], pa.binary()),
                "counts": pa.array([counts[common].tobytes()], pa.binary()),
                "classes": pa.array([classes], pa.list_(pa.int64())),
            }
        )

    sent = texts.select("text").mapInArrow(send, "part int, hashes binary, counts binary")
    return sent.groupBy("part").applyInArrow(
        count, "part int, twice binary, hashes binary, counts binary, classes array<long>"
    )


class Order:
    """A global order of shingles: those without a class by hash, then the common ones, rarer classes first."""

    def __init__(self, ranges: DataFrame, most: int):
        sums = ranges.select(*[F.sum(F.col("classes")[k]).alias(f"c{k}") for k in range(40)]).first()
        #: Shingles of at least 2^level texts are common, as long as there are few enough of them.
        self.level = next(k for k in range(2, 41) if k == 40 or (sums[k] or 0) <= most)
        least = 1 << self.level

        def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for hashes, counts in zip(batch.column(0), batch.column(1)):
                    counts = np.frombuffer(counts.as_buffer(), "<i8")
                    found = np.frombuffer(hashes.as_buffer(), "<u8")[counts >= least].astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found), pa.array(np.log2(counts[counts >= least]).astype(np.int8))], ["hash", "class"]
                    )

        table = ranges.select("hashes", "counts").mapInArrow(common, "hash long, class byte").toArrow()
        hashes = table["hash"].to_numpy().astype(np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.classes = hashes[order], table["class"].to_numpy()[order]
        rows = ranges.select("part", "twice").collect()
        size = len(rows[0]["twice"]) if rows else 1
        self.twice = np.zeros(size << RANGES, np.uint8)
        self.shift = np.uint64(64 - (size << RANGES + 3).bit_length() + 1)
        for row in rows:
            self.twice[row["part"] * size : (row["part"] + 1) * size] = np.frombuffer(row["twice"], np.uint8)

    def prefix(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shingles, places) of a set's prefix in this order, without shingles of this set alone.

        Two alike sets have a shingle in both prefixes: the first n - ceil(0.8 n) + 1 of n.
        """
        n = len(own)
        size = n - -(-LEAST[0] * n // LEAST[1]) + 1
        kind = np.zeros(n, np.int8)
        if len(self.hashes):
            at = np.searchsorted(self.hashes, own)
            at[at == len(self.hashes)] = 0
            kind = np.where(self.hashes[at] == own, self.classes[at], 0)
        first = np.argsort(kind, kind="stable")[:size]  # the set is sorted by hash
        grams = own[first]
        place = (grams >> self.shift).astype(np.int64)
        shared = self.twice[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1 == 1
        return grams[shared], np.flatnonzero(shared)


def prefixes(texts: DataFrame, order: Order) -> DataFrame:
    """(gram, node, n, most, sketch): the shingles of each text's prefix; the sketch is at its first row, others have none.

    ``n`` is the size of the text's set, ``most`` the largest set that may be alike to it if this is the
    first shingle they share: of 9 n_common >= 4 (n + n_other), what follows in the order is n_common at best.
    """
    known = texts.sparkSession.sparkContext.broadcast(order)
    up, down = LEAST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            columns: list[list[np.ndarray]] = [[], [], [], []]
            sketches, lengths = [np.zeros(0, np.int64)], [np.zeros(1, np.int32)]
            for node, own in zip(batch.column(0).to_pylist(), shingle_sets(raw_texts(batch.column(1)))):
                grams, places = known.value.prefix(own)
                rest = len(own) - places
                values = grams.astype(np.int64), np.full(len(grams), node), np.full(len(grams), len(own)), (up + down) * rest // up - len(own)
                for column, value in zip(columns, values):
                    column.append(value)
                if len(grams):
                    sketches.append(sketch(own))
                    lengths.append(np.where(np.arange(len(grams)) == 0, SKETCH, 0).astype(np.int32))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            arrays = [pa.array(np.concatenate([*c, np.zeros(0, np.int64)]), k) for c, k in zip(columns, kinds)]
            offsets = np.cumsum(np.concatenate(lengths), dtype=np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sketches))))
            yield pa.RecordBatch.from_arrays(arrays, ["gram", "node", "n", "most", "sketch"])

    return texts.select("node", "text").mapInArrow(run, "gram long, node long, n int, most int, sketch array<long>")


def judged(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose texts are alike, by their sets of 64-bit hashes."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sets = [x.tobytes() for x in shingle_sets(raw_texts(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "grams"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(iter([batch])):
                keep = []
                for x, y in zip(part.column(2), part.column(3)):
                    x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                    at = np.searchsorted(y, x)
                    at[at == len(y)] = 0
                    keep.append(alike(int((y[at] == x).sum()), len(x), len(y)))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = settle(
        texts.select("node", "text").join(wanted, "node", "left_semi").mapInArrow(hashed, "node long, grams binary"), "shingle-sets"
    )
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a")
    both = one.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def may_be_alike(x: str, y: str) -> Column:
    """Whether entries of two texts, x the smaller set and low, allow that this is the first shingle they share.

    The sketches bound from below in how many shingles the sets differ: a ninth of both sizes at most if they are alike.
    """
    apart = sum(F.bit_count(F.col(f"{x}.sketch.s{k}").bitwiseXOR(F.col(f"{y}.sketch.s{k}"))) for k in range(SKETCH))
    up, down = LEAST
    return (
        F.col(f"{y}.n").between(F.col(f"{x}.n"), F.col(f"{x}.most")) & (F.col(f"{x}.n") <= F.col(f"{y}.most"))
        & (F.col(f"{x}.root") != F.col(f"{y}.root"))
        & ((up + down) * apart <= (down - up) * (F.col(f"{x}.n") + F.col(f"{y}.n")))
    )


def low_high(found: DataFrame) -> DataFrame:
    """The pairs of nodes of x and y, the smaller first, once."""
    return found.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def near_links(
    texts: DataFrame, most_common: int = MOST_COMMON, map_bits: int = MAP_BITS, known: DataFrame | None = None
) -> DataFrame:
    """Links (a, b) of alike texts that connect any two alike texts; ``texts`` is a written table (node, text).

    ``known`` are stars (a, b), b the smallest node of its group, that are connected whatever their texts; they
    are among the links, and pairs they connect aren't judged.

    Shingles are counted exactly and ordered, rare ones first, so that passages of many texts come last and
    outside the prefixes. Of two alike sets the smaller has the first common shingle among its first ninth,
    where its ``most`` is no less than its size: it is *low*. Shingles of few pairs wait for the end. At the others, in
    a turn each text is judged against one low text at each shingle of its prefix, then 1, 4 and 16 others a turn, unless they are connected already; so groups of
    near copies of any size grow together in few turns of a few pairs a text. What is connected follows from one
    star round a turn, which may miss some of it but claims nothing else. A turn's questions go to low texts chosen by
    hash, so those that may be alike say how many of all pairs may be. When these are few, or wide turns connect
    little, all pairs are judged that share a shingle, may be alike by size, place and sketch and aren't
    known to be connected: no link between unconnected texts is lost.
    """
    spark = texts.sparkSession
    order = Order(settle(shingle_ranges(texts, map_bits), "shingle-counts"), most_common)
    entries = settle(prefixes(texts, order), "prefixes").withColumn("low", F.col("most") >= F.col("n"))
    sketches = entries.filter(F.size("sketch") > 0).select(
        "node", F.struct(*[F.col("sketch")[k].alias(f"s{k}") for k in range(SKETCH)]).alias("sketch")
    )
    met = entries.groupBy("gram").agg(F.count(F.lit(1)).alias("c"), F.count_if("low").alias("l")).filter("c > 1 and l > 0")
    met = met.select("gram", ((F.col("c") - 1) * F.col("l") > ALL_PAIRS * F.col("c")).alias("hot"))
    entries = settle(entries.drop("sketch").join(settle(met, "shared"), "gram").join(sketches, "node"), "entries")
    pool = entries.filter("hot")
    asked = spark.createDataFrame([], "a long, b long")
    links = stars = asked if known is None else known
    turn, before = 0, 0
    while True:
        roots = stars.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        pool = settle(pool.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "pool")
        own = pool.groupBy("gram", "root").agg(F.count(F.lit(1)).alias("c"), F.count_if("low").alias("l"))
        apart = own.groupBy("gram").agg(F.sum("c").alias("c"), F.expr("sum(c) * sum(l) - sum(c * l)").alias("pairs"))
        apart = settle(apart.filter("pairs > 0"), "apart")
        size = apart.agg(F.sum("c").alias("c"), F.sum("pairs").alias("pairs")).first()
        left = pool.join(apart.select("gram"), "gram", "left_semi")
        if (size["pairs"] or 0) <= ALL_PAIRS * (size["c"] or 0):
            break
        # Low texts by smallest size, then by as many different hashes as the turn has questions.
        wide = min(4 ** (turn - 1), WIDEST) if turn else 0
        firsts = [F.struct(F.xxhash64("node", "gram", F.lit(turn), F.lit(k)), "node") for k in range(wide)] or [F.struct("n", "node")]
        one = F.struct("node", "n", "most", "root", "sketch")
        lead = left.filter("low").groupBy("gram").agg(
            F.array_distinct(F.array(*[F.min_by(one, f) for f in firsts])).alias("x"), F.count(F.lit(1)).alias("l")
        )
        lead = lead.select("gram", (F.col("l") / F.size("x")).alias("each"), F.explode("x").alias("x"))
        other = F.struct("node", "n", "most", "root", "sketch", "low").alias("y")
        found = left.select("gram", other).join(settle(lead, "leaders"), "gram")
        found = found.filter(may_be_alike("x", "y") | F.col("y.low") & may_be_alike("y", "x"))
        # Each question stands for those to ``each`` low texts, so their sum is what judging all pairs would meet.
        maybe = settle(
            found.groupBy(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).agg(
                F.sum(F.when(may_be_alike("x", "y"), F.col("each")).otherwise(0.0)).alias("stands")
            ),
            "maybe-alike",
        )
        likely = maybe.agg(F.sum("stands")).first()[0] or 0
        if turn and likely <= ALL_PAIRS * size["c"] or before and USEFUL * (before - likely) < before:
            break
        pairs = settle(maybe.select("a", "b").join(asked, ["a", "b"], "left_anti"), "pairs")
        new = settle(judged(pairs, texts), "alike")
        links, asked = links.unionByName(new), asked.unionByName(pairs)
        stars = star_round(stars.unionByName(new))
        turn, before = turn + 1, likely if wide == WIDEST else 0
        pool = left.drop("root")
    rest = left.unionByName(entries.filter("not hot").withColumn("root", F.col("node")))
    pairs = low_high(rest.filter("low").alias("x").join(rest.alias("y"), "gram").filter(may_be_alike("x", "y")))
    pairs = settle(pairs.join(asked, ["a", "b"], "left_anti"), "pairs")
    for end in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    unconnected = pairs.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    return links.unionByName(settle(judged(settle(unconnected, "unconnected"), texts), "alike"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", by_fingerprint: bool = False) -> DataFrame:
    """One row of each group of near copies: that of the smallest doc_id.

    Texts of equal words are merged first, so a group of copies of any size is one node. A group is
    what links of alike texts connect; every two alike texts are in one group. With ``by_fingerprint`` the classes
    of :func:`simhash.near_duplicates` are links too, so texts of one class are in one group as well. Texts without a word are
    copies of each other. Rows that share a doc_id and differ are rows of their own; of a group's rows with
    the smallest doc_id that of the smallest hash over all columns stays, so reruns agree. Rows without an id
    stay. No rows give none.
    """
    rows = keyed(docs, doc_id, text)
    texts = rows.select("doc_id", "key", F.col(f"row.`{text}`").cast("binary").alias("text"))
    forms = settle(text_forms(texts), "forms")
    repeated = settle(forms.groupBy("doc_id", "key").count().filter("count > 1").select("doc_id", "key"), "repeats")
    firsts = forms.groupBy("form").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    firsts = settle(firsts.select(F.monotonically_increasing_id().alias("node"), "first.*"), "distinct-texts")
    texts = settle(once(texts.join(firsts, ["doc_id", "key"]), repeated).select("node", "text"), "texts")
    known = None
    if by_fingerprint:
        same = simhash.near_duplicates(texts, "node").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
        known = settle(same.filter("a <> b"), "fingerprint-links")
    roots = components(near_links(texts, known=known), "a", "b")
    grouped = firsts.join(roots, "node", "left").withColumn("group", F.coalesce("root", "node"))
    first = settle(grouped.groupBy("group").agg(F.min(F.struct("doc_id", "key")).alias("first")).select("first.*"), "kept")
    kept = once(rows.join(first, ["doc_id", "key"], "left_semi"), repeated).select("row.*")
    return kept.unionByName(docs.filter(F.col(f"`{doc_id}`").isNull()))
