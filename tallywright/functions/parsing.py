"""Parsing and normalisation of strings found in benchmark artefacts.

Every function takes and returns a Column built from Spark SQL functions, so
it runs inside the JVM and takes part in code generation and pruning.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats of the artefacts.
STDERR_SUFFIX = "_stderr"
NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
QUANTISATIONS = r"(?i)(NVFP4|MXFP4|INT4|INT8|FP8|BF16|FP16)"
STRING_MAP = "map<string,string>"
MCQ_TEMPLATE = (
    "What is the correct answer to this question:{question}\n"
    "Choices:\n(A) {choice1}\n(B) {choice2}\n(C) {choice3}\n(D) {choice4}\n\n"
    "Think step by step, then give your final answer on a new line in EXACTLY this format:\n"
    "The answer is (X)\nwhere X is one of A, B, C, or D."
)
NUMBER_TEMPLATE = (
    "Q: {question}\n\nSolve this step by step. Then, on the final line, give your answer in "
    "EXACTLY this format:\nThe answer is <number>\nwhere <number> is a plain integer with no "
    "commas, units, currency symbols, or formatting.\nA:"
)


def _group(text: Column, pattern: str, index: int = 1) -> Column:
    """Capture group of the first match, null instead of an empty string."""
    return F.nullif(F.regexp_extract(text, pattern, index), F.lit(""))


def split_metric_key(key: Column) -> Column:
    """``"exact_match_stderr,answer-line"`` -> struct(metric, filter, is_stderr)."""
    parts = F.split(key, ",")
    name = F.get(parts, F.lit(0))
    return F.struct(
        F.regexp_replace(name, STDERR_SUFFIX + "$", "").alias("metric"),
        F.get(parts, F.lit(1)).alias("filter"),
        name.endswith(STDERR_SUFFIX).alias("is_stderr"),
    )


def parse_model_args(text: Column) -> Column:
    """A ``k=v,k=v`` string or a JSON object -> map; only the first ``=`` splits."""
    return F.when(
        F.ltrim(text).startswith("{"), F.from_json(text, STRING_MAP)
    ).otherwise(F.str_to_map(text, F.lit(","), F.lit("=")))


def parse_model_id(model: Column) -> Column:
    """``org/Name-30B-A3B-FP8`` -> struct(org, name, total_b, active_b, quantisation)."""
    name = F.regexp_replace(model, "^[^/]*/", "")
    return F.struct(
        _group(model, "^([^/]+)/").alias("org"),
        name.alias("name"),
        _group(name, r"(?:^|[^A-Za-z0-9.])" + NUMBER + r"[Bb](?:[^A-Za-z0-9]|$)")
        .try_cast("double")
        .alias("total_b"),
        _group(name, r"(?:^|[^A-Za-z0-9])A" + NUMBER + r"[Bb](?:[^A-Za-z0-9]|$)")
        .try_cast("double")
        .alias("active_b"),
        F.upper(_group(name, QUANTISATIONS)).alias("quantisation"),
    )


def parse_run_clock(epoch: Column, duration: Column) -> Column:
    """Epoch seconds and a duration string -> struct(run_ts, eval_seconds)."""
    return F.struct(
        F.timestamp_seconds(epoch.try_cast("double")).alias("run_ts"),
        duration.try_cast("double").alias("eval_seconds"),
    )


def parse_instance_id(instance: Column) -> Column:
    """``org__repo-123`` -> struct(org, repo, number); repo may itself hold dashes."""
    return F.struct(
        _group(instance, "^(.*?)__").alias("org"),
        _group(instance, "(?:^|__)((?:[^_]|_[^_])*)-[0-9]+$").alias("repo"),
        _group(instance, "-([0-9]+)$").try_cast("bigint").alias("number"),
    )


def parse_duration(text: Column) -> Column:
    """``9h15m``, ``10m47s``, ``518.9 s``, ``MM:SS`` or ``HH:MM:SS`` -> seconds."""
    def unit(letter: str, seconds: int) -> Column:
        found = _group(text, NUMBER + r"\s*" + letter + r"(?:[^a-z]|$)").try_cast("double")
        return found * seconds

    parts = [unit("h", 3600), unit("m", 60), unit("s", 1)]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    clock = F.aggregate(
        F.split(F.trim(text), ":"),
        F.lit(0.0),
        lambda acc, part: acc * 60 + part.try_cast("double"),
    )
    return F.when(F.trim(text).rlike(r"^[0-9]+(:[0-9]{2}){1,2}(\.[0-9]+)?$"), clock).when(
        F.coalesce(*parts).isNotNull(), total
    )


def parse_measure(text: Column) -> Column:
    """A displayed cell -> struct(value, unit, denominator, qualifier, state).

    ``state`` separates a number (``measured``) from the ways of having none:
    ``not_measured``, ``blocked`` and ``excluded``. None of these is a zero.
    """
    bare = F.trim(F.regexp_replace(text, r"\*\*|`|[¹²³⁴⁵⁶⁷⁸⁹⁰]", ""))
    plain = F.regexp_replace(bare, r"(?<=[0-9]),(?=[0-9]{3}(?![0-9]))", "")
    number = r"^([~≈≥≤<>+±]*)\s*(-?[0-9]+(?:\.[0-9]+)?)"
    value = _group(plain, number, 2).try_cast("double")
    mark, bracket = _group(plain, number, 1), _group(plain, r"\(([^)]*)\)")
    return F.struct(
        value.alias("value"),
        _group(plain, number + r"\s*(%|[A-Za-zµ][A-Za-zµ/]*)", 3).alias("unit"),
        _group(plain, number + r"\s*/\s*([0-9]+)", 3).try_cast("double").alias("denominator"),
        F.when(bracket.isNull() | (F.coalesce(mark, F.lit("")) == ""), F.coalesce(bracket, mark))
        .otherwise(F.concat(mark, F.lit(" "), bracket))
        .alias("qualifier"),
        F.when(value.isNotNull(), "measured")
        .when(F.lower(plain).startswith("blocked"), "blocked")
        .when(F.lower(plain).startswith("excluded"), "excluded")
        .when(plain.rlike("^[—–-]+$") | (plain == ""), "not_measured")
        .otherwise("text")
        .alias("state"),
    )


def as_share(measure: Column) -> Column:
    """A parsed measure on the scale of scores: ``97.19%`` and ``29/30`` become shares."""
    value = measure["value"]
    return (
        F.when(measure["unit"] == "%", value / 100)
        .when(measure["denominator"].isNotNull(), F.try_divide(value, measure["denominator"]))
        .otherwise(value)
    )


def normalise_verdict(text: Column) -> Column:
    """``VERDICT: CLEAN`` / ``clean`` / empty -> ``CLEAN`` or null."""
    return F.nullif(F.upper(F.trim(F.regexp_replace(text, r"^\s*VERDICT:\s*", ""))), F.lit(""))


def clean_text(text: Column, drop_brackets: bool = True) -> Column:
    """Tidy a dataset string; null becomes one space. Both published variants."""
    out = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    out = F.replace(out, F.lit(" [title]"), F.lit(". "))
    if drop_brackets:
        out = F.regexp_replace(out, r"\[[^\n]*?\]", "")
    return F.coalesce(F.replace(out, F.lit("  "), F.lit(" ")), F.lit(" "))


def build_prompt(template: str, **fields: Column) -> Column:
    """Fill ``{name}`` places of a template; inserted text is never re-scanned."""
    pieces: list[Column] = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name:
            pieces.append(F.coalesce(fields[name].cast("string"), F.lit("")))
    return F.concat(*pieces)


def shuffle_choices(doc_id: Column, choices: Column, correct: Column, seed: int) -> Column:
    """Hash-ordered choices and the gold letter; the same on every cluster.

    ``correct`` names the right answer's text; equal texts share the first place.
    """
    ordered = F.transform(
        F.array_sort(
            F.transform(
                choices,
                lambda c: F.struct(
                    F.md5(
                        F.concat_ws("|", doc_id.cast("string"), c, F.lit(str(seed)))
                    ).alias("h"),
                    c.alias("choice"),
                ),
            )
        ),
        lambda s: s["choice"],
    )
    place = F.array_position(ordered, correct)
    return F.struct(
        ordered.alias("choices"),
        F.concat(
            F.lit("("), F.when(place > 0, F.chr(place + 64)).otherwise(""), F.lit(")")
        ).alias("answer"),
    )


def split_reasoning(text: Column) -> Column:
    """Separate ``<think>...</think>`` from the answer.

    A block that is never closed swallows the rest: the budget ran out while
    the model was reasoning and there is no answer.
    """
    return F.struct(
        F.coalesce(
            _group(text, r"(?s)<think>(.*?)</think>"), _group(text, r"(?s)<think>(.*)$")
        ).alias("reasoning"),
        F.trim(
            F.regexp_replace(
                F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*$", ""
            )
        ).alias("answer"),
    )


def classify_patch(patch: Column) -> Column:
    """``valid`` diff, ``garbage`` text or ``empty`` submission."""
    return (
        F.when(F.coalesce(F.trim(patch), F.lit("")) == "", "empty")
        .when(patch.startswith("diff --git"), "valid")
        .otherwise("garbage")
    )
