"""Rows that every operator must take: nulls, empty and very long texts, ties, repeats, clashing names."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, kept string, fp int, "
    "size int, host string, score string, name string, _words string"
)


def prose(rng: random.Random, n: int, letters: str = "abcdefgh") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n))


def edge_rows() -> list[tuple]:
    rng = random.Random(4)
    long = prose(rng, 60_000)
    texts = [
        (0, None, "en", "a"), (1, "", "en", "a"), (2, " \n\t ", None, None), (3, "word", "de", "b"),
        (4, "Two words", None, "b"), (5, "x" * 3_000, "en", None), (6, "a " * 500, "en", "a"),
        (7, long, "en", "a"), (8, long + " end", "en", "b"), (9, "é" * 450 + " 1.2.3.4", "fr", "c"),
        (None, "no id here at all", "en", "c"), (10, "123 456", "en", "c"), (10, "123 456", "en", "c"),
        (11, "one@two.org +1 (743) 555-3824", "en", ""), (11, "same id, another text", "en", "a"),
    ]
    clash = ("x", 1, 2, "h", "s", "n", "w")
    return [(d, t, g, s, None if t is None else len(t), *clash) for d, t, g, s in texts]


def edge_frame(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def no_rows(spark):
    return spark.createDataFrame([], SCHEMA)
