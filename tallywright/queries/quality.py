"""Scoring queries over responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywright.functions import answers, parsing
from tallywright.operators import comparison, scoring, trust, verdicts
from tallywright.operators.keys import join_on
from tallywright.plans import quality as quality_plan
from tallywright.queries.bindings import LANGS, MCQ, resp, score_table, scored, table, verd, views
from tallywright.queries.registry import register, rounded

_LAST = "list_extract(regexp_extract_all({text}, '{pattern}', {group}), -1)"
_TEXT = "coalesce(content, '')"


def _last(pattern: str, group: int = 1, text: str = _TEXT) -> str:
    return _LAST.format(text=text, pattern=pattern, group=group)


def _numbered(spark, sf_dir):
    """Responses that also state numbers."""
    n = F.col("n_chars").cast("string")
    line = F.concat(
        F.coalesce("content", F.lit("")), F.lit(" The answer is $"), n, F.lit(",000. Total "),
        F.col("doc_id").cast("string"), F.lit("."),
    )
    return resp(spark, sf_dir).select("doc_id", "n_chars", line.alias("content"))


_NUMBERED = views("resp", numbered="""SELECT doc_id, n_chars,
  coalesce(content, '') || ' The answer is $' || n_chars || ',000. Total ' || doc_id || '.' AS content
  FROM resp""")


@register("leaderboard", views("scores") + """
SELECT system, """ + ", ".join(
    f"round(max(score) FILTER (WHERE task = '{t}'), 6) AS {t}" for t in LANGS
) + " FROM scores GROUP BY system")
def leaderboard(spark, sf_dir):
    board = quality_plan.quality_leaderboard(resp(spark, sf_dir), LANGS)
    return rounded(board, **{t: 6 for t in LANGS})


@register("headline_scores", views("scored") + """
SELECT system, task, 'exact_match' AS metric, CASE WHEN task = 'en' THEN 'line' ELSE 'fallback' END AS filter,
  FALSE AS is_stderr, round(avg(CAST(CASE WHEN task = 'en' THEN ok_line ELSE ok_fallback END AS INT)), 6) AS value
FROM scored WHERE task IN ('en', 'de', 'fr', 'es') GROUP BY system, task""")
def headline_scores(spark, sf_dir):
    both = F.array(
        F.struct(F.lit("line").alias("filter"), F.col("ok_line").alias("ok")),
        F.struct(F.lit("fallback").alias("filter"), F.col("ok_fallback").alias("ok")),
    )
    metrics = (
        scored(spark, sf_dir)
        .select("system", "task", F.explode(both).alias("f"))
        .groupBy("system", "task", F.lit("exact_match").alias("metric"), F.col("f.filter").alias("filter"))
        .agg(F.avg(F.col("f.ok").cast("int")).alias("value"))
        .withColumn("is_stderr", F.lit(False))
    )
    chosen = {"en": ("exact_match", "line"), "de": ("exact_match", "fallback"),
              "fr": ("exact_match", "fallback"), "es": ("exact_match", "fallback")}
    out = scoring.headline_scores(metrics, chosen)
    return rounded(out.select("system", "task", "metric", "filter", "is_stderr", "value"), value=6)


@register("score_summary", views("scores") + """
SELECT system, task, n, n_correct, round(score, 6) AS score,
  CASE WHEN n > 1 THEN round(sqrt(score * (1 - score) / (n - 1)), 6) END AS stderr
FROM scores""")
def score_summary(spark, sf_dir):
    return rounded(score_table(spark, sf_dir), score=6, stderr=6)


@register("label_summary", """
SELECT count(*) AS n, CAST(sum(quality) AS BIGINT) AS n_correct, round(avg(quality), 6) AS score,
  round(stddev_samp(quality) / sqrt(count(*)), 6) AS stderr, toxic
FROM labels GROUP BY toxic""")
def label_summary(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return rounded(scoring.score_summary(labels, ["toxic"], "quality"), score=6, stderr=6)


@register("sample_margin", views("verd") + """,
s AS (SELECT system, count(*) AS n, count(*) FILTER (WHERE resolved) / count(*) AS score
  FROM verd GROUP BY system)
SELECT system, n, round(score, 6) AS score, round(sqrt(score * (1 - score) / n), 6) AS margin,
  round(greatest(0, score - sqrt(score * (1 - score) / n)), 6) AS low,
  round(least(1, score + sqrt(score * (1 - score) / n)), 6) AS high
FROM s""")
def sample_margin(spark, sf_dir):
    scores = scoring.score_summary(verd(spark, sf_dir), ["system"], "resolved")
    out = scoring.sample_margins(scores.select("system", "n", "score"))
    return rounded(out, score=6, margin=6, low=6, high=6)


@register("extract_last", views("resp") + f"""
SELECT doc_id, {_last('([a-z]+) The', 1)} AS word FROM resp""")
def extract_last(spark, sf_dir):
    content = answers.guard_null(F.col("content"))
    return resp(spark, sf_dir).select(
        "doc_id", answers.extract_last(content, "([a-z]+) The").alias("word")
    )


@register("extract_mcq", views("resp") + f"SELECT doc_id, {_last(MCQ)} AS pred FROM resp")
def extract_mcq(spark, sf_dir):
    content = answers.guard_null(F.col("content"))
    return resp(spark, sf_dir).select("doc_id", answers.extract_mcq(content).alias("pred"))


@register("extract_mcq_fallback", views("resp") + rf"""
SELECT doc_id, {_last(r'\(([A-D])\)')} AS pred, {_last(r'(\([A-Z]\))')} AS pred_any FROM resp""")
def extract_mcq_fallback(spark, sf_dir):
    content = answers.guard_null(F.col("content"))
    return resp(spark, sf_dir).select(
        "doc_id",
        answers.extract_mcq_fallback(content).alias("pred"),
        answers.extract_mcq_fallback(content, any_letter=True).alias("pred_any"),
    )


@register("extract_number", _NUMBERED + rf"""
SELECT doc_id, replace({_last(r'[Tt]he answer is\s*\$?\s*(-?[0-9][0-9,]*)', text='content')},
  ',', '') AS pred FROM numbered""")
def extract_number(spark, sf_dir):
    return _numbered(spark, sf_dir).select(
        "doc_id", answers.extract_number(F.col("content")).alias("pred")
    )


@register("extract_number_fallback", _NUMBERED + f"""
SELECT doc_id, replace({_last('(-?[0-9][0-9,]*)', text='content')}, ',', '') AS pred
FROM numbered""")
def extract_number_fallback(spark, sf_dir):
    return _numbered(spark, sf_dir).select(
        "doc_id", answers.extract_number_fallback(F.col("content")).alias("pred")
    )


@register("extract_stock", _NUMBERED + rf"""
SELECT doc_id,
  nullif(regexp_extract(content, 'The answer is (\-?[0-9\.\,]+).', 1), '') AS strict,
  {_last('(-?[$0-9.,]{{2,}})|(-?[0-9]+)', 0, 'content').replace('{{', '{').replace('}}', '}')} AS flexible
FROM numbered""")
def extract_stock(spark, sf_dir):
    content = F.col("content")
    return _numbered(spark, sf_dir).select(
        "doc_id",
        answers.extract_stock_strict(content).alias("strict"),
        answers.extract_stock_flexible(content).alias("flexible"),
    )


@register("gold_target", """
SELECT item_id, trim(replace(list_extract(string_split(
  text || ' #### ' || (item_id * 1234) || ',5', '#### '), -1), ',', '')) AS gold
FROM benchmark""")
def gold_target(spark, sf_dir):
    marked = F.concat(
        F.col("text"), F.lit(" #### "), (F.col("item_id") * 1234).cast("string"), F.lit(",5")
    )
    return table(spark, sf_dir, "benchmark").select(
        "item_id", answers.gold_target(marked).alias("gold")
    )


@register("exact_match", _NUMBERED + rf"""
SELECT doc_id, coalesce(
  regexp_replace(regexp_replace(regexp_replace(lower({_last('(-?[$0-9.,]{{2,}})|(-?[0-9]+)', 0, 'content')}),
    ',', '', 'g'), '\$', '', 'g'), '\.$', '', 'g') = CAST(n_chars % 100 AS VARCHAR), FALSE) AS correct
FROM numbered""".replace("{{", "{").replace("}}", "}"))
def exact_match(spark, sf_dir):
    pred = answers.extract_stock_flexible(F.col("content"))
    gold = (F.col("n_chars") % 100).cast("string")
    correct = answers.exact_match(pred, gold, regexes=answers.STOCK_IGNORE)
    return _numbered(spark, sf_dir).select("doc_id", correct.alias("correct"))


@register("guard_null", views("scored") + """
SELECT system, count(*) AS n, count(*) FILTER (WHERE content IS NULL) AS n_null,
  CAST(count(*) FILTER (WHERE content IS NULL AND ok_line) AS BIGINT) AS n_null_correct
FROM scored GROUP BY system""")
def guard_null(spark, sf_dir):
    empty = F.col("content").isNull()
    return scored(spark, sf_dir).groupBy("system").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(empty).alias("n_null"),
        F.count_if(empty & F.col("ok_line")).alias("n_null_correct"),
    )


_AGREEMENT = """
SELECT system, count(*) AS n,
  round(avg(CASE WHEN pred_line IS NOT DISTINCT FROM pred_fallback THEN 1 ELSE 0 END), 6) AS agreement,
  round(avg(CAST(ok_line AS INT)), 6) AS score_first,
  round(avg(CAST(ok_fallback AS INT)), 6) AS score_second,
  round(avg(CAST(ok_line AS INT)) - avg(CAST(ok_fallback AS INT)), 6) AS score_gap"""


def _agreement(spark, sf_dir):
    content = answers.guard_null(F.col("content"))
    # The second reader looks at lower-case letters too, so the two can part.
    both = scoring.score_responses(
        resp(spark, sf_dir),
        {"line": answers.extract_mcq(content),
         "fallback": answers.extract_last(content, "([A-D])[^A-D]*$")},
    )
    return scoring.filter_agreement(both, ["system"], "line", "fallback")


_LOOSE = views(
    "resp",
    loose=rf"""SELECT *, {_last(MCQ)} AS pred_line,
  {_last('([A-D])[^A-D]*$')} AS pred_fallback FROM resp""",
    both_ok="""SELECT *, coalesce(lower(pred_line) = lower(gold), FALSE) AS ok_line,
  coalesce(lower(pred_fallback) = lower(gold), FALSE) AS ok_fallback FROM loose""",
)


@register("filter_agreement", _LOOSE + _AGREEMENT + " FROM both_ok GROUP BY system")
def filter_agreement(spark, sf_dir):
    return rounded(_agreement(spark, sf_dir), agreement=6, score_first=6, score_second=6,
                   score_gap=6)


@register("extractor_gate", _LOOSE + _AGREEMENT + """,
  abs(avg(CAST(ok_line AS INT)) - avg(CAST(ok_fallback AS INT))) > 0.01 AS suspect
FROM both_ok GROUP BY system""")
def extractor_gate(spark, sf_dir):
    gated = trust.extractor_gate(_agreement(spark, sf_dir), limit=0.01)
    return rounded(gated, agreement=6, score_first=6, score_second=6, score_gap=6)


def _checks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    n = F.col("n_chars")
    return docs.select(
        F.col("source").alias("system"),
        F.array(n > 100, F.col("lang") == "en", n % 2 == 0).alias("strict"),
        F.array(n > 50, F.col("lang").isin("en", "de"), n % 2 == 0).alias("loose"),
    )


_CHECKS = """WITH checks AS (
  SELECT source AS system, [n_chars > 100, lang = 'en', n_chars % 2 = 0] AS strict,
    [n_chars > 50, lang IN ('en', 'de'), n_chars % 2 = 0] AS loose FROM documents),
inst AS (SELECT system, count(*) AS n_prompts, CAST(sum(len(strict)) AS BIGINT) AS n_instructions,
  avg(CASE WHEN list_bool_and(strict) THEN 1 ELSE 0 END) AS prompt_strict,
  sum(len(list_filter(strict, lambda x: x))) / sum(len(strict)) AS inst_strict,
  avg(CASE WHEN list_bool_and(loose) THEN 1 ELSE 0 END) AS prompt_loose,
  sum(len(list_filter(loose, lambda x: x))) / sum(len(loose)) AS inst_loose
  FROM checks GROUP BY system)
"""


@register("instruction_scores", _CHECKS + """
SELECT system, n_prompts, n_instructions, round(prompt_strict, 6) AS prompt_strict,
  round(inst_strict, 6) AS inst_strict, round(prompt_loose, 6) AS prompt_loose,
  round(inst_loose, 6) AS inst_loose FROM inst""")
def instruction_scores(spark, sf_dir):
    out = scoring.instruction_scores(_checks(spark, sf_dir), ["system"])
    return rounded(out, prompt_strict=6, inst_strict=6, prompt_loose=6, inst_loose=6)


@register("level_pair_anomaly", _CHECKS + """
SELECT system, inst_strict < prompt_strict AS strict_anomaly,
  inst_loose < prompt_loose AS loose_anomaly FROM inst""")
def level_pair_anomaly(spark, sf_dir):
    return trust.level_pair_anomaly(
        scoring.instruction_scores(_checks(spark, sf_dir), ["system"]), ["system"]
    )


@register("extract_replay", views("resp") + rf"""
SELECT doc_id, upper(coalesce({_last(MCQ, text='c')}, {_last('[A-Da-d]', 0, 'right(c, 20)')})) AS pred
FROM (SELECT doc_id, CASE WHEN n_chars % 5 = 0 THEN coalesce(content, '')
  ELSE coalesce(content, '') || ' so (' || substr('abcd', CAST(n_chars % 4 AS INT) + 1, 1) || ')' END AS c0,
  replace(c0, 'The answer', CASE WHEN n_chars % 2 = 0 THEN 'The answer' ELSE 'Answer' END) AS c
  FROM resp)""")
def extract_replay(spark, sf_dir):
    n = F.col("n_chars")
    base = F.coalesce("content", F.lit(""))
    said = F.concat(
        base, F.lit(" so ("), F.substr(F.lit("abcd"), (n % 4).cast("int") + 1, F.lit(1)), F.lit(")")
    )
    text = F.replace(
        F.when(n % 5 == 0, base).otherwise(said), F.lit("The answer"),
        F.when(n % 2 == 0, "The answer").otherwise("Answer"),
    )
    return resp(spark, sf_dir).select("doc_id", answers.extract_replay(text).alias("pred"))


@register("tool_call_errors", """
WITH calls AS (SELECT event_id, event_type,
  CASE WHEN event_id % 4 = 0 THEN substr(props, 1, length(props) - 1)
    WHEN event_id % 4 = 1 THEN '[' || props || ']'
    WHEN event_id % 4 = 2 THEN '' ELSE props END AS args,
  'Error parsing tool call arguments: Expecting delimiter: line 1 column 9 (char ' || event_id || ').' AS msg
  FROM events)
SELECT event_type, coalesce(CASE WHEN args = '' THEN 'empty' WHEN NOT json_valid(args) THEN 'malformed'
    WHEN NOT starts_with(args, '{') THEN 'not_object' END, 'ok') AS error_class,
  count(*) AS n, CAST(max(CAST(regexp_extract(msg, '\\(char ([0-9]+)\\)', 1) AS BIGINT)) AS BIGINT) AS last_offset
FROM calls GROUP BY ALL""".replace("\\\\", "\\"))
def tool_call_errors(spark, sf_dir):
    i, props = F.col("event_id"), F.col("props")
    args = (
        F.when(i % 4 == 0, F.substr(props, F.lit(1), F.length(props) - 1))
        .when(i % 4 == 1, F.concat(F.lit("["), props, F.lit("]")))
        .when(i % 4 == 2, F.lit(""))
        .otherwise(props)
    )
    message = F.concat(
        F.lit("Error parsing tool call arguments: Expecting delimiter: line 1 column 9 (char "),
        i.cast("string"), F.lit(")."),
    )
    calls = table(spark, sf_dir, "events").select(
        "event_type",
        F.coalesce(answers.tool_call_error(args), F.lit("ok")).alias("error_class"),
        answers.error_offset(message).alias("offset"),
    )
    return calls.groupBy("event_type", "error_class").agg(
        F.count(F.lit(1)).alias("n"), F.max("offset").alias("last_offset")
    )


@register("format_compliance", views("resp") + rf"""
SELECT system, task, count(*) AS n,
  round(avg(CASE WHEN regexp_matches(content, '{MCQ}') THEN 1 ELSE 0 END), 6) AS compliant
FROM resp GROUP BY system, task""")
def format_compliance(spark, sf_dir):
    out = scoring.format_compliance(resp(spark, sf_dir), ["system", "task"], answers.MCQ_LINE)
    return rounded(out, compliant=6)


@register("truncation_curve", views("scored") + """
SELECT task, count(*) AS n, count(*) FILTER (WHERE finish_reason <> 'length') AS answered,
  count(*) FILTER (WHERE finish_reason = 'length') AS truncated,
  round(avg(CASE WHEN finish_reason = 'length' THEN 1 ELSE 0 END), 6) AS truncated_share,
  round(avg(CAST(ok_line AS INT)), 6) AS raw_score,
  round(avg(CAST(ok_line AS INT)) FILTER (WHERE finish_reason <> 'length'), 6) AS answered_score
FROM scored GROUP BY task""")
def truncation_curve(spark, sf_dir):
    out = scoring.truncation_curve(scored(spark, sf_dir), ["task"], "ok_line")
    return rounded(out, truncated_share=6, raw_score=6, answered_score=6)


@register("partial_and_strict", """
SELECT l_returnflag AS system, count(*) AS n, round(avg(l_discount * 10), 6) AS partial,
  round(avg(CASE WHEN l_discount * 10 >= 1 THEN 1 ELSE 0 END), 6) AS strict
FROM lineitem GROUP BY l_returnflag""")
def partial_and_strict(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("system"), (F.col("l_discount") * 10).alias("credit")
    )
    return rounded(scoring.partial_and_strict(items, ["system"], "credit"), partial=6, strict=6)


@register("null_rate_gate", views("resp") + """
SELECT system, count(*) AS n, round(avg(CASE WHEN content IS NULL THEN 1 ELSE 0 END), 6) AS null_rate,
  avg(CASE WHEN content IS NULL THEN 1 ELSE 0 END) > 0.15 AS budget_bound
FROM resp GROUP BY system""")
def null_rate_gate(spark, sf_dir):
    return rounded(trust.null_rate_gate(resp(spark, sf_dir), ["system"], 0.15), null_rate=6)


def _trials(spark, sf_dir):
    return _checks(spark, sf_dir).select(
        "system",
        F.size(F.filter("strict", lambda x: x)).alias("hits"),
        F.size("strict").alias("trials"),
    )


@register("bootstrap_ci")
def bootstrap_ci(spark, sf_dir):
    return scoring.bootstrap_ci(_trials(spark, sf_dir), ["system"], "hits", "trials", iterations=1000)


@register("bootstrap_error", _CHECKS + """,
counts AS (SELECT system, len(list_filter(strict, lambda x: x)) AS h, len(strict) AS t FROM checks),
ratios AS (SELECT system, count(*) AS n, sum(h) / sum(t) AS r, sum(t) AS t FROM counts GROUP BY system),
errors AS (SELECT c.system, sqrt(sum((c.h - r * c.t) * (c.h - r * c.t))) / any_value(q.t) AS e
  FROM counts c JOIN ratios q ON c.system IS NOT DISTINCT FROM q.system GROUP BY c.system)
SELECT q.system, n, round(r, 6) AS estimate, round(e, 6) AS formula_error, e > 0 AS varies,
  e > 0 AS error_agrees, e > 0 AS bracketed
FROM ratios q JOIN errors x ON q.system IS NOT DISTINCT FROM x.system""")
def bootstrap_error(spark, sf_dir):
    """The bootstrap beside the closed formula of a ratio's error: within 15 %, and around the estimate."""
    trials = _trials(spark, sf_dir)
    drawn = scoring.bootstrap_ci(trials, ["system"], "hits", "trials", iterations=1000)
    off = F.col("hits") - F.col("estimate") * F.col("trials")
    closed = join_on(trials, drawn, ["system"], "inner").groupBy("system").agg(
        (F.sqrt(F.sum(off * off)) / F.sum("trials")).alias("formula_error")
    )
    both = join_on(drawn, closed, ["system"], "inner")
    error = F.col("formula_error")
    out = both.select(
        "system", "n", "estimate", error, (error > 0).alias("varies"),
        ((F.col("stderr") > error * 0.85) & (F.col("stderr") < error * 1.15)).alias("error_agrees"),
        ((F.col("low") < F.col("estimate")) & (F.col("estimate") < F.col("high"))).alias("bracketed"),
    )
    return rounded(out, estimate=6, formula_error=6)


@register("rank_models", views("scores") + """
SELECT system, task, round(score, 6) AS score,
  CAST(rank() OVER w AS INT) AS rank, CAST(dense_rank() OVER w AS INT) AS dense_rank,
  rank() OVER w = 1 AS best
FROM scores WINDOW w AS (PARTITION BY task ORDER BY score DESC)""")
def rank_models(spark, sf_dir):
    scores = score_table(spark, sf_dir).select("system", "task", "score")
    return rounded(comparison.rank_models(scores), score=6)


_RANKS = views("scores", wide="""SELECT system, max(score) FILTER (WHERE task = 'en') AS a,
    max(score) FILTER (WHERE task = 'de') AS b FROM scores GROUP BY system""",
               ranked="""SELECT system, rank() OVER (ORDER BY a DESC) AS rank_first,
    rank() OVER (ORDER BY b DESC) AS rank_second FROM wide WHERE a IS NOT NULL AND b IS NOT NULL""")


@register("rank_inversion", _RANKS + """
SELECT system, CAST(rank_first AS INT) AS rank_first, CAST(rank_second AS INT) AS rank_second,
  CAST(rank_second - rank_first AS INT) AS rank_change FROM ranked""")
def rank_inversion(spark, sf_dir):
    return comparison.rank_inversion(score_table(spark, sf_dir), "en", "de")


@register("spearman", _RANKS + """
SELECT count(*) AS n_systems, round(corr(CAST(rank_first AS DOUBLE), CAST(rank_second AS DOUBLE)), 6) AS spearman
FROM ranked""")
def spearman(spark, sf_dir):
    ranks = comparison.rank_inversion(score_table(spark, sf_dir), "en", "de")
    return rounded(comparison.spearman(ranks), spearman=6)


@register("vs_baseline", views("scores") + """
SELECT s.system, s.task, round(s.score, 6) AS value, round(r.score, 6) AS reference,
  round(s.score - r.score, 6) AS delta,
  CASE WHEN r.score <> 0 THEN round(s.score / r.score, 6) END AS ratio
FROM scores s LEFT JOIN scores r ON r.system = 'src0' AND r.task = s.task
WHERE s.system <> 'src0'""")
def vs_baseline(spark, sf_dir):
    out = comparison.vs_baseline(score_table(spark, sf_dir), "src0", ["task"])
    return rounded(out, value=6, reference=6, delta=6, ratio=6)


@register("missing_matrix", views("scores", tasks="""SELECT unnest(['de', 'en', 'es', 'fr', 'it', 'zh']) AS task""") + """
SELECT m.system, t.task, CASE WHEN t.task = 'zh' THEN 'excluded' ELSE 'not measured' END AS state
FROM (SELECT DISTINCT system FROM scores) m, tasks t
WHERE NOT EXISTS (SELECT 1 FROM scores s WHERE s.system = m.system AND s.task = t.task)""")
def missing_matrix(spark, sf_dir):
    scores = score_table(spark, sf_dir)
    states = scores.select("system", F.lit("zh").alias("task"), F.lit("excluded").alias("state"))
    return comparison.missing_matrix(scores, [*LANGS, "it", "zh"], states=states.distinct())


@register("rerun_worklist", views("resp") + """
SELECT doc_id, quality FROM labels
WHERE doc_id IN (SELECT doc_id FROM resp WHERE finish_reason = 'length')""")
def rerun_worklist(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return verdicts.rerun_worklist(
        labels, resp(spark, sf_dir), ["doc_id"], F.col("finish_reason") == "length"
    )


@register("split_metric_key", """
SELECT doc_id, 'acc_' || lang AS metric, source AS filter, n_chars % 2 = 0 AS is_stderr FROM documents""")
def split_metric_key(spark, sf_dir):
    key = F.concat(
        F.lit("acc_"), F.col("lang"), F.when(F.col("n_chars") % 2 == 0, "_stderr").otherwise(""),
        F.lit(","), F.col("source"),
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id", parsing.split_metric_key(key).alias("k")
    ).select("doc_id", "k.*")
