"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.rows import let, with_columns, words_of

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that with for der die das und ein den mit nicht le la les de des et un "
    "une que du est pour el los las en por con"
).split()
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A text of at least ``min_words`` words breaks the rule when
    ``value`` is over (``most``) or under (``least``) the given hundredths of ``per``."""

    name: str
    value: str
    per: str
    most: int | None = None
    least: int | None = None
    min_words: int = 1


#: Broken by texts that no reader would miss.
BASE = (
    Rule("too_short", "n_words", "one", least=2000, min_words=0),
    Rule("repeated_windows", "n_repeat_words", "n_words", most=30),
)
#: The thresholds of the method; whole numbers, so that no rounding decides.
RULES = (
    Rule("symbols", "n_symbols", "n_words", most=30),
    Rule("long_words", "word_chars", "n_words", most=1200),
    Rule("short_words", "word_chars", "n_words", least=200),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=50),
    Rule("stop_words", "n_stop_words", "n_words", least=1, min_words=100),
)
COUNTS = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_stop_words".split()
)


def broken(rule: Rule, record: str = "_counts") -> Column:
    value = F.col(f"{record}.{rule.value}") * 100
    per = F.lit(1) if rule.per == "one" else F.col(f"{record}.{rule.per}")
    test = value > per * rule.most if rule.most is not None else value < per * rule.least
    return (F.col(f"{record}.n_words") >= rule.min_words) & test


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more: the windows are sorted by hash,
    those with an equal neighbour kept, and the lengths of their union added up."""
    sorted_pairs = F.array_sort(
        F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    )

    def repeated(pairs: Column) -> Column:
        def twin(p: Column, k: Column) -> Column:
            same = lambda at: F.coalesce(F.get(pairs, at)["h"] == p["h"], F.lit(False))
            return same(k - 1) | same(k + 1)

        return F.array_sort(F.transform(F.filter(pairs, twin), lambda p: p["i"]))

    def total(starts: Column) -> Column:
        gains = F.transform(
            starts,
            lambda x, k: F.when(k == 0, WINDOW).otherwise(F.least(x - F.get(starts, k - 1), F.lit(WINDOW))),
        )
        return F.aggregate(gains, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(let(sorted_pairs, repeated), total)


def score_quality(
    docs: DataFrame,
    text: str = "text",
    base: tuple[Rule, ...] = BASE,
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """Counts and verdicts beside the documents' own columns, in the scan's own stage.

    Adds :data:`COUNTS`, ``base_failed``, ``broken`` (names of the broken rules) and ``kept``.
    Null and empty texts have no words and break ``too_short``. Nothing is shuffled, so equal
    rows get equal results and an empty table gives an empty one. Windows of a text are compared
    by 64-bit hash within that text. An own column named like an added one is replaced.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    split = docs.withColumn("_words", words_of(F.col(text))).withColumn(
        "_lines", F.filter(F.split(content, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    size = F.size("_words")
    windows = F.when(
        size > WINDOW,
        F.transform(
            F.sequence(F.lit(1), F.greatest(size - WINDOW + 1, F.lit(1))),
            lambda i: F.xxhash64(F.slice("_words", i, F.lit(WINDOW))),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    split = split.withColumn("_windows", windows)
    lines = F.size("_lines")
    counts = F.struct(
        size.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length(content) - F.length(F.translate(content, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (lines - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_windows")) == F.size("_windows"), F.lit(0).cast("long"))
        .otherwise(_covered(F.col("_windows"))).alias("n_repeat_words"),
        lines.cast("long").alias("n_lines"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
    )
    counted = split.withColumn("_counts", counts).drop("_words", "_lines", "_windows")
    failed = F.lit(False)
    for rule in base:
        failed = failed | broken(rule)
    names = F.array_compact(F.array(*[F.when(broken(r), F.lit(r.name)) for r in (*base, *rules)]))
    # A filter on the verdict must not be moved below the projections: it would repeat the word split
    # for every use. The row number, always true here, is what Spark moves no filter across.
    pinned = F.monotonically_increasing_id() >= 0
    verdict = F.struct(
        "_counts.*", failed.alias("base_failed"), names.alias("broken"), ((F.size(names) == 0) & pinned).alias("kept")
    )
    return with_columns(
        counted.withColumn("_quality", verdict).drop("_counts"),
        [*COUNTS, "base_failed", "broken", "kept"], "_quality",
    )


def kept_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that break no rule, with their own columns only."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_text"))
    return score_quality(own, "_text").filter("kept").select("_row.*")


def rule_sql(rules: tuple[Rule, ...]) -> str:
    """The rules as a SQL condition over :data:`COUNTS`, true where none is broken."""
    parts = []
    for r in rules:
        per = "1" if r.per == "one" else r.per
        test = f"100 * {r.value} > {r.most} * {per}" if r.most is not None else f"100 * {r.value} < {r.least} * {per}"
        parts.append(f"NOT (n_words >= {r.min_words} AND {test})")
    return " AND ".join(parts)
