"""Mixing sources to target weights by pivotal dependent rounding, in built-in functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywright.llm.rows import words_of
from tallywright.workspace import settle

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
FAN = 64
SNAP = 1e-12


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """(source, source_size, target) from rows (source, source_size), one per source.

    Sources in code-point order, null last, take the weights in turn and divide ``share`` of all
    sizes by them, each up to ``most`` times its own size. In order of size per weight, a source is
    at its limit if the level of those not yet settled is above it, and the level of the rest
    rises; the highest level met is the final one. Windows hold one row per source, no documents.
    """
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    rated = sizes.withColumn("w", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn % len(weights))).withColumn(
        "cap", F.col("source_size") * most
    )
    by_ratio = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    left = F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    levelled = rated.withColumn("level", left / weight)
    top = F.max("level").over(every)
    return levelled.select("source", "source_size", F.least("cap", top * F.col("w")).alias("target"))


def _uniform(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") * F.lit(2.0**-53)


def _pair(level: int, seed: int):
    """Folds one more item into a block's open item: one of the two becomes whole."""

    def step(state: Column, b: Column) -> Column:
        a = state["open"]
        up = F.least((1 - a["p"]) * a["size"], b["p"] * b["size"])
        down = F.least(a["p"] * a["size"], (1 - b["p"]) * b["size"])
        u = _uniform(F.lit(seed), F.lit(level), a["doc_id"], a["size"], b["doc_id"], b["size"])
        a_up = u * (up + down) < down
        moved = F.when(a_up, up).otherwise(-down)
        pa, pb = a["p"] + moved / a["size"], b["p"] - moved / b["size"]
        a_whole = F.when(a_up, (1 - a["p"]) * a["size"] <= b["p"] * b["size"]).otherwise(
            a["p"] * a["size"] <= (1 - b["p"]) * b["size"]
        )

        def put(x: Column, p: Column) -> Column:
            fields = ("order", "doc_id", "size", "n_rows", "base")
            return F.struct(*[x[f].alias(f) for f in fields], F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)).alias("p"))

        whole = F.when(a_whole, put(a, F.round(pa))).otherwise(put(b, F.round(pb)))
        rest = F.when(a_whole, put(b, pb)).otherwise(put(a, pa))
        return F.struct(rest.alias("open"), F.concat(state["done"], F.array(whole)).alias("done"))

    return step


def mix(
    docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
    weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0,
) -> DataFrame:
    """(source, doc_id, size, n_rows, copies, part, source_size, target) for each kind of row.

    Rows with the same doc_id, source and size count as ``n_rows`` equal items. ``copies`` is the
    number of whole copies all of them get together; ``part`` a number of further words, which one
    item per source has, so that its source meets its target within a word.

    Every item of a source is wanted target / source size times: a whole number and a fraction.
    Fractions are rounded in pairs: words move from one item to the other, chance decides which
    way, until one fraction is 0 or 1; the sum of words stays, and each item's expectation too.
    About 64 items form a block by a hash of their id, folded in one task; the blocks' open items
    form the blocks of the next level, until one per source is left, whose fraction is paid in
    words. Blocks have no more items however large a source is. Chance is a hash of ids and
    ``seed``, so reruns agree and the order of rows doesn't matter. Items without a word get
    nothing; null texts have none; a null source is a source, the last; no rows give no rows.
    """
    items = settle(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
            F.size(words_of(F.col(text))).cast("long").alias("size"),
        ).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n_rows")),
        "mix-items",
    )
    stats = items.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n_rows")).alias("source_size"),
        F.count_if(F.col("size") > 0).alias("n_items"),
    )
    wanted = settle(
        source_targets(stats.select("source", "source_size"), weights, share, most)
        .join(stats.select(F.col("source").alias("s"), "n_items"), F.col("source").eqNullSafe(F.col("s")))
        .select("source", "source_size", "target", F.ceil(F.col("n_items") / FAN).alias("n_blocks")),
        "mix-targets",
    )
    names = ("source", "source_size", "target")
    own = items.join(
        wanted.withColumnsRenamed({c: f"_{c}" for c in names}), F.col("source").eqNullSafe(F.col("_source"))
    )
    copies = F.when(F.col("size") > 0, F.col("n_rows") * F.col("_target") / F.col("_source_size")).otherwise(0.0)
    own = own.withColumn("whole", F.floor(copies + SNAP)).withColumn(
        "p", F.greatest(copies - F.col("whole"), F.lit(0.0))
    )
    record = F.struct(
        F.xxhash64(F.lit(seed), "doc_id", "size").alias("order"), "doc_id", "size", "n_rows",
        F.col("whole").alias("base"), "p",
    )
    block = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "size"), F.greatest("n_blocks", F.lit(1)))
    open_items = own.filter(F.col("p") > SNAP).select("source", block.alias("block"), record.alias("x"))
    done = [own.filter(F.col("p") <= SNAP).select("source", "doc_id", "size", "n_rows", F.col("whole").alias("copies"), F.lit(0).cast("long").alias("part"))]
    blocks = wanted.agg(F.max("n_blocks")).first()[0] or 1
    level = 0
    while True:
        queue = F.array_sort(F.collect_list("x"))
        start = F.struct(F.get("queue", F.lit(0)).alias("open"), F.slice("queue", 1, 0).alias("done"))
        folded = settle(
            open_items.groupBy("source", "block").agg(queue.alias("queue")).select(
                "source", "block",
                F.aggregate(F.slice("queue", F.lit(2), F.size("queue")), start, _pair(level, seed)).alias("s"),
            ),
            f"mix-level-{level}",
        )
        x = F.explode("s.done").alias("x")
        done.append(
            folded.select("source", x).select(
                "source", "x.doc_id", "x.size", "x.n_rows", (F.col("x.base") + F.col("x.p").cast("long")).alias("copies"),
                F.lit(0).cast("long").alias("part"),
            )
        )
        if blocks <= 1:
            break
        open_items = folded.select("source", F.floor(F.col("block") / FAN).alias("block"), F.col("s.open").alias("x"))
        blocks = -(-blocks // FAN)
        level += 1
    words = F.round(F.col("s.open.p") * F.col("s.open.size")).cast("long")
    full = (words == F.col("s.open.size")).cast("long")
    done.append(
        folded.select(
            "source", "s.open.doc_id", "s.open.size", "s.open.n_rows", (F.col("s.open.base") + full).alias("copies"),
            (words * (1 - full)).alias("part"),
        )
    )
    decided = reduce(DataFrame.unionByName, done)
    joined = decided.join(wanted.select(F.col("source").alias("_s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_s")))
    return joined.drop("_s")


def _share_of(row: Column) -> tuple[Column, Column]:
    """Whole copies and further words of the ``row``-th (from 1) of the ``n_rows`` equal items."""
    whole = F.expr("copies") * row
    before = F.expr("copies") * (row - 1)
    copies = F.floor(whole / F.col("n_rows")) - F.floor(before / F.col("n_rows"))
    return copies, F.when(row == 1, F.col("part")).otherwise(0)


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) for every row of ``docs``."""
    each = mix(docs, **options).withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    copies, words = _share_of(F.col("row"))
    return each.select(
        "doc_id", "size", F.col("source_size"), "target", (copies * F.col("size") + words).alias("taken"), "source"
    )


KEYS = ("_id", "_no_id", "_source", "_no_source", "_size")


def _keys(doc_id: Column, source: Column, size: Column) -> list[Column]:
    """What tells kinds of rows apart, without nulls."""
    values = (F.coalesce(doc_id, F.lit(0)), doc_id.isNull(), F.coalesce(source, F.lit("")), source.isNull(), size)
    return [v.alias(k) for v, k in zip(values, KEYS)]


def mixed_documents(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their own columns.

    A part is the row's first words, joined by single spaces, with its length in ``n_chars``.
    """
    plan = mix(docs, text=text, **options).select(
        *_keys(F.col("doc_id"), F.col("source"), F.col("size")), "n_rows", "copies", "part"
    )
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_r"))
    size = F.size(words_of(F.col(f"_r.{text}"))).cast("long")
    # The shuffle comes before the join so that sorting compares a number, not an expression over texts.
    sized = row.select("_r", *_keys(F.col("_r.doc_id"), F.col("_r.source"), size)).repartition(*KEYS)
    joined = sized.join(plan, list(KEYS))
    same = W.partitionBy(*KEYS).orderBy(f"_r.{text}")
    single = joined.filter("n_rows = 1").withColumn("_k", F.lit(1).cast("long"))
    several = joined.filter("n_rows > 1").withColumn("_k", F.row_number().over(same).cast("long"))
    copies, words = _share_of(F.col("_k"))
    start = F.array_join(F.slice(words_of(F.col(f"_r.{text}")), F.lit(1), words.cast("int")), " ")
    fields = {text: start}
    if n_chars in docs.columns:
        fields[n_chars] = F.length(start).cast(docs.schema[n_chars].dataType)
    cut = F.array(F.struct(*[fields.get(c, F.col(f"_r.`{c}`")).alias(c) for c in docs.columns]))
    own = F.concat(
        F.array_repeat(F.col("_r"), copies.cast("int")), F.slice(cut, F.lit(1), (words > 0).cast("int"))
    )
    return single.unionByName(several).select(F.explode(own).alias("_r")).select("_r.*")
