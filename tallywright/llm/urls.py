"""URL filters: rules first, then the ratio of two character language models; built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywright.llm.rows import with_columns
from tallywright.workspace import settle

ORDER = 5
START = "\x02"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("block", "net", "/"),
    UrlRule("allow", "example.net", "/en/"),
    UrlRule("block", "example.com", "/de/"),
    UrlRule("allow", "org", "/fr/"),
)


def by_length(rules: tuple[UrlRule, ...]) -> list[UrlRule]:
    return sorted(rules, key=lambda r: (-len(r.name), r.name))


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for urls without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """Name of the longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for r in reversed(by_length(rules)):
        own = (host == r.host) | host.endswith("." + r.host)
        found = F.when(own & path.startswith(r.path), F.lit(r.name)).otherwise(found)
    return found


def _grams(urls: DataFrame, *keep: str) -> DataFrame:
    """A row per character: it and the four before it, ``START`` before the first."""
    chars = urls.withColumn("_c", F.split(F.concat(F.lit(START * (ORDER - 1)), "url"), ""))
    each = F.transform(
        F.sequence(F.lit(0), F.length("url") - 1),
        lambda i: F.concat(*[F.get(F.col("_c"), i + k) for k in range(ORDER)]),
    )
    return chars.filter(F.length("url") > 0).select(*keep, F.explode(each).alias("gram"))


def language_models(grams: DataFrame) -> DataFrame:
    """(gram, gain) from counts (gram, a, r) of 5-grams in accepted and rejected urls.

    ``gain`` is log P(last character | the four before) under the accepted model less the same
    under the rejected one. A context's probabilities are its counts smoothed by those of the
    context one shorter, in the weight of its number of different next characters; a context that
    was never seen passes on to the shorter one, so the order varies from place to place. At the
    end stands an even chance for every character seen and one unseen.
    """
    last = F.substr("gram", F.lit(ORDER))
    even = F.lit(1.0 / (grams.agg(F.count_distinct(last).alias("k")).first()["k"] + 1))
    smooth = None
    for k in range(1, ORDER + 1):
        counts = grams.groupBy(F.substr("gram", F.lit(ORDER + 1 - k)).alias("s")).agg(
            F.sum("a").alias("a"), F.sum("r").alias("r")
        )
        context = F.substr("s", F.lit(1), F.lit(k - 1)) if k > 1 else F.lit("")
        counts = counts.withColumn("ctx", context)
        totals = counts.groupBy("ctx").agg(
            F.sum("a").alias("na"), F.sum("r").alias("nr"),
            F.count_if(F.col("a") > 0).alias("da"), F.count_if(F.col("r") > 0).alias("dr"),
        )
        joined = counts.join(totals, "ctx")
        if smooth is None:
            joined = joined.withColumns({"qa": even, "qr": even})
        else:
            shorter = smooth.select(F.col("s").alias("tail"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
            joined = joined.withColumn("tail", F.substr("s", F.lit(2))).join(shorter, "tail")

        def mixed(c: str, n: str, d: str, q: str) -> Column:
            p = (F.col(c) + F.col(d) * F.col(q)) / (F.col(n) + F.col(d))
            return F.when(F.col(n) > 0, p).otherwise(F.col(q))

        smooth = joined.select("s", mixed("a", "na", "da", "qa").alias("pa"), mixed("r", "nr", "dr", "qr").alias("pr"))
    return smooth.select(F.col("s").alias("gram"), (F.log("pa") - F.log("pr")).alias("gain"))


def threshold(scored: DataFrame) -> DataFrame:
    """One row (cut): where (score, accepted) rows part with the least balanced error.

    Scores are counted in steps of a hundredth, about 2,000 rows at most whatever the input. The cut
    is the middle of the gap below a step; ties go to the step nearest 0. Without rows of both kinds the cut is 0.
    """
    steps = scored.groupBy(F.floor(F.col("score") * 100).alias("step")).agg(
        F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r")
    )
    below = W.orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    lost = F.coalesce(F.sum("a").over(below), F.lit(0)) / F.sum("a").over(every)
    passed = 1 - F.coalesce(F.sum("r").over(below), F.lit(0)) / F.sum("r").over(every)
    error = F.round(lost + passed, 9)
    gap = F.coalesce(F.lag("step").over(W.orderBy("step")) + 1, F.col("step"))
    best = steps.select("step", error.alias("e"), gap.alias("from")).filter("e is not null").agg(
        F.min(F.struct("e", F.abs("step").alias("far"), "step", "from")).alias("best")
    )
    return best.select(F.coalesce((F.col("best.step") + F.col("best.from")) / 200, F.lit(0.0)).alias("cut"))


def judge_urls(pages: DataFrame, url: str = "url", rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """``host``, ``path``, ``rule``, ``score`` and ``verdict`` beside the pages' own columns.

    A url that a rule fits gets the longest rule's verdict. The others are scored: the models are
    counted over all urls that rules allow or block, three of 16 of which (by MD5) only set the
    threshold; the score is the gain per character, and a url at or over the threshold is allowed.
    Null and empty urls score 0, as does every url while one of the models has no urls. Each distinct
    url is scored once, whole; repeated rows get equal results; an empty table gives an empty one.
    An own column named like an added one is replaced.
    """
    content = F.coalesce(F.col(url), F.lit(""))
    host, path = parts(F.col(url))
    names = {r.name: r.verdict for r in rules}
    distinct = settle(
        pages.select(content.alias("url")).distinct()
        .withColumn("rule", rule_of(*parts(F.col("url")), rules))
        .withColumn(
            "kind",
            F.when(F.col("rule").isin([n for n, v in names.items() if v == "allow"]), 1)
            .when(F.col("rule").isNotNull(), -1).otherwise(0),
        )
        .withColumn("held", F.substr(F.md5("url"), F.lit(1), F.lit(1)).isin("0", "1", "2")),
        "urls",
    )
    learned = ~F.col("held")
    counts = settle(
        _grams(distinct, "kind", "held").groupBy("gram").agg(
            F.count_if(learned & (F.col("kind") == 1)).alias("a"), F.count_if(learned & (F.col("kind") == -1)).alias("r")
        ),
        "url-grams",
    )
    gains = settle(language_models(counts), "url-gains")
    asked = distinct.filter((F.col("kind") == 0) | F.col("held"))
    scored = settle(
        _grams(asked, "url", "kind").join(gains, "gram").groupBy("url", "kind").agg(
            F.round(F.sum("gain") / F.count(F.lit(1)), 6).alias("score")
        ),
        "url-scores",
    )
    cut = threshold(scored.filter("kind <> 0").select("score", (F.col("kind") == 1).alias("accepted"))).first()["cut"]
    own = pages.withColumn("_url", content).withColumn("_rule", rule_of(host, path, rules))
    scores = scored.filter("kind = 0").select(F.col("url").alias("_url"), F.col("score").alias("_score"))
    joined = own.join(scores, "_url", "left")
    ruled = F.lit(None).cast("string")
    for name, verdict in names.items():
        ruled = F.when(F.col("_rule") == name, F.lit(verdict)).otherwise(ruled)
    score = F.when(F.col("_rule").isNull(), F.coalesce("_score", F.lit(0.0)))
    judged = F.struct(
        host.alias("host"), path.alias("path"), F.col("_rule").alias("rule"), score.alias("score"),
        F.coalesce(ruled, F.when(score >= F.lit(cut), "allow").otherwise("block")).alias("verdict"),
    )
    return with_columns(
        joined.withColumn("_judged", judged).drop("_url", "_rule", "_score"),
        ["host", "path", "rule", "score", "verdict"], "_judged",
    )
