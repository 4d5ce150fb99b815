"""N-gram overlap between a corpus and evaluation items.

Pairs of document and item are never formed: an n-gram shared by a third of
the corpus and by every item would make their number explode. Both reports
need only the question "does the other side have this n-gram?", which is a
semi-join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.operators.bloom import bloom_words, maybe_in
from tallywright.operators.keys import join_on
from tallywright.workspace import settle, spread

# Fixed value: words per n-gram.
NGRAM = 13
# Largest evaluation side that is broadcast, and what a row of it takes in memory.
BROADCAST_BYTES = 64 << 20
ROW_BYTES = 64
# Beyond that, a hot n-gram's corpus rows spread over this many join keys.
SALTS = 64


def _words(text: str) -> Column:
    """Lower-cased words of a whole text."""
    spaced = F.translate(F.lower(text), "\t\r\n", "   ")
    return F.array_remove(F.split(spaced, " "), "")


def _windows(words: str, n: int, combine: Callable[..., Column]) -> Column:
    """``combine`` applied to every n neighbouring elements of an array.

    Each result is put together from n element reads, so the cost is linear in
    the text; ``slice`` would copy the whole array for every position. A text
    shorter than n words gives null, which explodes to no rows.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0)))
    return F.when(
        F.size(words) >= n,
        F.transform(starts, lambda i: combine(*[F.get(words, i + k) for k in range(n)])),
    )


def ngram_rows(df: DataFrame, id_col: str, text: str, n: int = NGRAM) -> DataFrame:
    """One row per word n-gram position of each whole text."""
    worded = df.select(id_col, _words(text).alias("_w"))
    return worded.select(
        id_col, F.explode(_windows("_w", n, lambda *w: F.concat_ws(" ", *w))).alias("gram")
    )


def _hash_rows(df: DataFrame, id_col: str, text: str, n: int) -> DataFrame:
    """One row per n-gram position, as a 64-bit hash of the words' hashes."""
    hashed = df.select(
        id_col, F.transform(_words(text), lambda w: F.xxhash64(w)).alias("_w")
    )
    return hashed.select(id_col, F.explode(_windows("_w", n, F.xxhash64)).alias("gram"))


def _semi_join(
    rows: DataFrame, wanted: DataFrame, id_col: str, broadcast_bytes: int
) -> DataFrame:
    """Rows whose gram is wanted.

    The wanted side is written out and measured, grams by their bytes. Up to ``broadcast_bytes`` it is
    broadcast, and the corpus rows are filtered where they are. Beyond that a Bloom filter of fixed size
    drops most corpus rows where they are, and for the others the
    join key carries a salt taken from the document, with the wanted side
    repeated once per salt, so the rows of a hot gram have many partitions.
    """
    known = settle(wanted.distinct(), "evaluation-grams")
    size = known.agg(F.sum(F.octet_length(F.col("gram").cast("string")) + ROW_BYTES)).first()[0] or 0
    if size <= broadcast_bytes:
        return join_on(rows, F.broadcast(known), ["gram"], "left_semi", null_safe=False)
    words = settle(bloom_words(known, F.xxhash64("gram")), "evaluation-filter")
    rows = maybe_in(rows, F.xxhash64("gram"), words)
    salt = F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int")
    salted = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_salt", salt)
    return join_on(rows, salted, ["gram", "_salt"], "left_semi", null_safe=False).drop("_salt")


def corpus_hits(
    corpus: DataFrame, items: DataFrame, corpus_id: str, item_id: str, n: int = NGRAM,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Distinct corpus n-grams (document, gram) that some evaluation item also has.

    A first pass compares hashes and keeps the documents that may have a hit;
    equal n-grams have equal hashes, so none is lost. The second pass compares
    the n-grams themselves, for those documents only.
    """
    texts = spread(corpus.select(corpus_id, "text"), corpus_id)
    wanted_hashes = _hash_rows(items, item_id, "text", n).select("gram")
    maybe = settle(
        _semi_join(
            _hash_rows(texts, corpus_id, "text", n), wanted_hashes, corpus_id, broadcast_bytes
        )
        .select(corpus_id)
        .distinct(),
        "candidate-documents",
    )
    documents = join_on(texts, maybe, [corpus_id], "left_semi", null_safe=False)
    wanted = ngram_rows(items, item_id, "text", n).select("gram")
    return _semi_join(
        ngram_rows(documents, corpus_id, "text", n), wanted, corpus_id, broadcast_bytes
    ).distinct()


def item_contamination(
    corpus: DataFrame, items: DataFrame, corpus_id: str, item_id: str, n: int = NGRAM,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Per evaluation item: its n-grams and how many the corpus holds.

    Corpus n-grams are reduced to those the items have and then to distinct
    ones, so what is joined back is bounded by the evaluation set.
    """
    found = corpus_hits(corpus, items, corpus_id, item_id, n, broadcast_bytes).select("gram").distinct()
    marked = join_on(
        ngram_rows(items, item_id, "text", n).distinct(), found.withColumn("_hit", F.lit(1)), ["gram"], "left",
        null_safe=False,
    )
    per_item = marked.groupBy(item_id).agg(
        F.count(F.lit(1)).alias("n_grams"), F.count("_hit").alias("n_found")
    )
    return per_item.withColumn("share", F.col("n_found") / F.col("n_grams"))


def document_contamination(
    corpus: DataFrame, items: DataFrame, corpus_id: str, item_id: str, n: int = NGRAM,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Per document that holds any evaluation n-gram: how many it holds."""
    return corpus_hits(corpus, items, corpus_id, item_id, n, broadcast_bytes).groupBy(corpus_id).agg(
        F.count(F.lit(1)).alias("n_hits")
    )
