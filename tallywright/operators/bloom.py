"""Bloom filters as small tables: words of 64 bits, joined like any other table.

A key sets four bits of one word, so a filter is built by a grouped OR with map-side combine and asked by
one broadcast join. It has at most ``1 << bits`` rows whatever is put in; a fuller filter lets more through
but never loses a key, so an exact join has to follow.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A million words: about 40 MB as a broadcast, and one key in 25 passes wrongly at eight million keys.
WORD_BITS = 20


def _word(key: Column, bits: int) -> Column:
    return F.pmod(key, F.lit(1 << bits))


def _mask(key: Column, bits: int) -> Column:
    """Four of 64 bits, from parts of the key that don't choose the word."""
    places = (F.shiftrightunsigned(key, bits + 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(4))
    one = F.lit(1).cast("bigint")
    return reduce(Column.bitwiseOR, (F.call_function("shiftleft", one, place) for place in places))


def bloom_words(keys: DataFrame, key: Column, bits: int = WORD_BITS) -> DataFrame:
    """The filter of a 64-bit hash ``key``: (word, mask), at most ``1 << bits`` rows."""
    return keys.select(_word(key, bits).alias("word"), _mask(key, bits).alias("mask")).groupBy("word").agg(
        F.bit_or("mask").alias("mask")
    )


def maybe_in(rows: DataFrame, key: Column, words: DataFrame, bits: int = WORD_BITS) -> DataFrame:
    """Rows whose key may be in the filter: all that are, and a few others. Rows stay where they are."""
    asked = rows.withColumns({"_word": _word(key, bits), "_mask": _mask(key, bits)})
    held = F.broadcast(words.select(F.col("word").alias("_held_word"), F.col("mask").alias("_held_mask")))
    fits = (F.col("_word") == F.col("_held_word")) & (
        F.col("_held_mask").bitwiseAND(F.col("_mask")) == F.col("_mask")
    )
    return asked.join(held, fits, "left_semi").drop("_word", "_mask")
