"""Answer extraction and exact-match scoring over response text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and settings of the scored tasks.
MCQ_LINE = r"[Tt]he answer is \(?([A-D])\)?"
MCQ_LETTER = r"\(([A-D])\)"
MCQ_ANY_LETTER = r"(\([A-Z]\))"
LOOSE_LETTER = r"[A-Da-d]"
NUMBER_LINE = r"[Tt]he answer is\s*\$?\s*(-?[0-9][0-9,]*)"
LAST_NUMBER = r"(-?[0-9][0-9,]*)"
STOCK_STRICT = r"The answer is (\-?[0-9\.\,]+)."
STOCK_FLEXIBLE = r"(-?[$0-9.,]{2,})|(-?[0-9]+)"
STOCK_IGNORE = (",", r"\$", r"(?s).*#### ", r"\.$")
NUMBER_IGNORE = (",", r"\$", r"\.")
PUNCTUATION = r"\p{Punct}"
GOLD_MARK = "#### "
REPLAY_TAIL = 20


def guard_null(content: Column) -> Column:
    """A response with no content scores as an empty one; the run goes on."""
    return F.coalesce(content, F.lit(""))


def extract_last(content: Column, pattern: str, group: int = 1) -> Column:
    """Capture group of the last match, null when nothing matches."""
    return F.try_element_at(
        F.regexp_extract_all(content, F.lit(pattern), F.lit(group)), F.lit(-1)
    )


def extract_first(content: Column, pattern: str, group: int = 1) -> Column:
    """Capture group of the first match, null when nothing matches."""
    return F.nullif(F.regexp_extract(content, pattern, group), F.lit(""))


def extract_mcq(content: Column) -> Column:
    return extract_last(content, MCQ_LINE)


def extract_mcq_fallback(content: Column, any_letter: bool = False) -> Column:
    """Last ``(X)``; ``any_letter`` is the older variant that keeps the brackets."""
    return extract_last(content, MCQ_ANY_LETTER if any_letter else MCQ_LETTER)


def extract_number(content: Column) -> Column:
    return F.replace(extract_last(content, NUMBER_LINE), F.lit(","), F.lit(""))


def extract_number_fallback(content: Column) -> Column:
    return F.replace(extract_last(content, LAST_NUMBER), F.lit(","), F.lit(""))


def extract_stock_strict(content: Column) -> Column:
    return extract_first(content, STOCK_STRICT)


def extract_stock_flexible(content: Column) -> Column:
    return extract_last(content, STOCK_FLEXIBLE, 0)


def extract_replay(content: Column) -> Column:
    """Anchored answer, else the last letter among the final characters."""
    tail = F.right(content, F.lit(REPLAY_TAIL))
    return F.upper(F.coalesce(extract_mcq(content), extract_last(tail, LOOSE_LETTER, 0)))


def gold_target(text: Column) -> Column:
    """Text after the last ``#### ``, commas removed, trimmed."""
    return F.trim(
        F.replace(F.substring_index(text, GOLD_MARK, -1), F.lit(","), F.lit(""))
    )


def normalise_answer(
    text: Column,
    ignore_case: bool = True,
    ignore_punct: bool = False,
    regexes: Sequence[str] = (),
) -> Column:
    for pattern in regexes:
        text = F.regexp_replace(text, pattern, "")
    if ignore_case:
        text = F.lower(text)
    if ignore_punct:
        text = F.regexp_replace(text, PUNCTUATION, "")
    return text


def exact_match(
    pred: Column,
    gold: Column,
    ignore_case: bool = True,
    ignore_punct: bool = False,
    regexes: Sequence[str] = (),
) -> Column:
    """True when both sides agree after normalisation; no prediction is false."""
    same = normalise_answer(pred, ignore_case, ignore_punct, regexes) == normalise_answer(
        gold, ignore_case, ignore_punct, regexes
    )
    return F.coalesce(same, F.lit(False))


def tool_call_error(arguments: Column) -> Column:
    """Class of a tool call's argument string: null when it is a JSON object."""
    stripped = F.trim(arguments)
    return (
        F.when(F.coalesce(stripped, F.lit("")) == "", "empty")
        .when(F.try_parse_json(arguments).isNull(), "malformed")
        .when(~stripped.startswith("{"), "not_object")
    )


def error_offset(message: Column) -> Column:
    """Character offset quoted in a parser's error message."""
    return extract_first(message, r"\(char ([0-9]+)\)").try_cast("bigint")


def error_class(message: Column) -> Column:
    """Parser complaint without its position."""
    return F.trim(
        F.nullif(
            F.regexp_extract(message, r"(?:arguments|error): ?([^:\n]*?)(?:: line|\.|$)", 1),
            F.lit(""),
        )
    )
