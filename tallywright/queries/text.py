"""Parsing and prompt queries over strings built from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywright.functions import parsing
from tallywright.queries.bindings import table
from tallywright.queries.registry import register


@register("parse_model_args", """
SELECT event_id, 'm' || user_id AS model, regexp_extract(props, '([0-9]+)', 1) AS k,
  CASE WHEN event_id % 2 = 0 THEN 'http://h/?a=' || event_id END AS base_url
FROM events""")
def parse_model_args(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    model = F.concat(F.lit("m"), F.col("user_id").cast("string"))
    as_text = F.concat(
        F.lit("model="), model, F.lit(",k="), k, F.lit(",base_url=http://h/?a="),
        F.col("event_id").cast("string"),
    )
    as_object = F.concat(F.lit('{"model": "'), model, F.lit('", "k": '), k, F.lit("}"))
    raw = F.when(F.col("event_id") % 2 == 0, as_text).otherwise(as_object)
    args = table(spark, sf_dir, "events").select(
        "event_id", parsing.parse_model_args(raw).alias("m")
    )
    return args.select(
        "event_id",
        *[F.try_element_at("m", F.lit(c)).alias(c) for c in ("model", "k", "base_url")],
    )


@register("parse_model_id", """
SELECT p_partkey, replace(p_brand, '#', '') AS org,
  'Net-' || p_size || '.5B-A' || (p_size % 10) || 'B-' || CASE WHEN p_size % 3 = 0 THEN 'fp8' WHEN p_size % 3 = 1 THEN 'NVFP4' ELSE 'it' END AS name,
  p_size + 0.5 AS total_b, CAST(p_size % 10 AS DOUBLE) AS active_b,
  CASE WHEN p_size % 3 = 0 THEN 'FP8' WHEN p_size % 3 = 1 THEN 'NVFP4' END AS quantisation
FROM part""".replace("p_size + 0.5", "CAST(p_size + 0.5 AS DOUBLE)"))
def parse_model_id(spark, sf_dir):
    size = F.col("p_size")
    tail = F.when(size % 3 == 0, "fp8").when(size % 3 == 1, "NVFP4").otherwise("it")
    model = F.concat(
        F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/Net-"), size.cast("string"),
        F.lit(".5B-A"), (size % 10).cast("string"), F.lit("B-"), tail,
    )
    return table(spark, sf_dir, "part").select(
        "p_partkey", parsing.parse_model_id(model).alias("m")
    ).select("p_partkey", "m.*")


@register("parse_run_clock", """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS run_at,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS eval_seconds FROM events""")
def parse_run_clock(spark, sf_dir):
    epoch = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("string")
    seconds = F.when(F.col("event_id") % 5 == 0, "N/A").otherwise(F.col("value").cast("string"))
    clock = table(spark, sf_dir, "events").select(
        "event_id", parsing.parse_run_clock(epoch, seconds).alias("c")
    )
    return clock.select(
        "event_id", F.date_format("c.run_ts", "yyyy-MM-dd HH:mm:ss").alias("run_at"),
        "c.eval_seconds",
    )


@register("parse_instance_id", """
SELECT c_custkey, lower(c_mktsegment) AS org, 'scikit-learn' AS repo, c_custkey AS number FROM customer""")
def parse_instance_id(spark, sf_dir):
    number = F.regexp_extract("c_name", r"#0*([0-9]+)$", 1)
    name = F.concat(F.lower("c_mktsegment"), F.lit("__scikit-learn-"), number)
    return table(spark, sf_dir, "customer").select(
        "c_custkey", parsing.parse_instance_id(name).alias("i")
    ).select("c_custkey", "i.*")


@register("parse_duration", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(event_id % 24 * 3600 + event_id % 60 * 60 AS DOUBLE)
  WHEN 1 THEN CAST(event_id % 60 * 60 + event_id % 59 AS DOUBLE)
  WHEN 2 THEN CAST(event_id % 60 * 60 + 7 AS DOUBLE)
  WHEN 3 THEN CAST(event_id % 24 * 3600 + 125 AS DOUBLE) ELSE NULL END AS seconds
FROM events""")
def parse_duration(spark, sf_dir):
    i = F.col("event_id")
    h, m, s = ((i % k).cast("string") for k in (24, 60, 59))
    text = (
        F.when(i % 5 == 0, F.concat(h, F.lit("h"), m, F.lit("m")))
        .when(i % 5 == 1, F.concat(m, F.lit("m"), s, F.lit("s")))
        .when(i % 5 == 2, F.concat(m, F.lit(":07")))
        .when(i % 5 == 3, F.concat(h, F.lit(":02:05")))
        .otherwise(F.lit("about an hour"))
    )
    return table(spark, sf_dir, "events").select(
        "event_id", parsing.parse_duration(text).alias("seconds")
    )


@register("parse_measure", """
WITH p AS (SELECT o_orderkey, o_orderkey % 6 AS kind, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders)
SELECT o_orderkey,
  CASE WHEN kind IN (0, 1, 2, 3) THEN CAST(v AS DOUBLE) END AS value,
  CASE kind WHEN 0 THEN '%' WHEN 1 THEN 'tok/s' END AS unit,
  CASE WHEN kind = 3 THEN 30.0::DOUBLE END AS denominator,
  CASE kind WHEN 1 THEN 'c=128, capped' WHEN 2 THEN '~' END AS qualifier,
  CASE WHEN kind <= 3 THEN 'measured' WHEN kind = 4 THEN 'not_measured' ELSE 'blocked' END AS state
FROM p""")
def parse_measure(spark, sf_dir):
    v = F.floor("o_totalprice").cast("bigint")
    text, kind = v.cast("string"), F.col("o_orderkey") % 6
    shown = (
        F.when(kind == 0, F.concat(F.lit("**"), text, F.lit("%**")))
        .when(kind == 1, F.concat(text, F.lit(" tok/s (c=128, capped)")))
        .when(kind == 2, F.concat(F.lit("~"), F.regexp_replace(text, r"([0-9])([0-9]{3})$", "$1,$2")))
        .when(kind == 3, F.concat(text, F.lit("/30")))
        .when(kind == 4, F.lit("—⁴"))
        .otherwise(F.lit("blocked²"))
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", parsing.parse_measure(shown).alias("m")
    ).select("o_orderkey", "m.*")


@register("normalise_verdict", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'CLEAN' WHEN 'O' THEN 'FIXED' END AS verdict FROM orders""")
def normalise_verdict(spark, sf_dir):
    status = F.col("o_orderstatus")
    raw = F.when(status == "F", "VERDICT: clean ").when(status == "O", "FIXED").otherwise("")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", parsing.normalise_verdict(raw).alias("verdict")
    )


@register("clean_text", r"""
WITH raw AS (SELECT doc_id, CASE WHEN n_chars % 9 = 0 THEN NULL
    ELSE '  ' || text || ' [title] x [b' || source || '] y  z ' END AS t FROM documents)
SELECT doc_id,
  md5(coalesce(replace(regexp_replace(replace(regexp_replace(t, '^\s+|\s+$', '', 'g'), ' [title]', '. '),
    '\[[^\n]*?\]', '', 'g'), '  ', ' '), ' ')) AS dropped,
  md5(coalesce(replace(replace(regexp_replace(t, '^\s+|\s+$', '', 'g'), ' [title]', '. '), '  ', ' '), ' ')) AS kept
FROM raw""")
def clean_text(spark, sf_dir):
    raw = F.when(
        F.col("n_chars") % 9 != 0,
        F.concat(F.lit("  "), "text", F.lit(" [title] x [b"), "source", F.lit("] y  z ")),
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(parsing.clean_text(raw)).alias("dropped"),
        F.md5(parsing.clean_text(raw, drop_brackets=False)).alias("kept"),
    )


def _choices(text):
    """Four answer choices: all of an item's words, dealt to them in turn."""
    words = F.split(text, " ")

    def dealt_to(i: int):
        return F.array_join(F.filter(words, lambda w, k: k % 4 == i), " ")

    dealt = map(dealt_to, range(4))
    return F.array(*[F.coalesce(F.nullif(d, F.lit("")), F.lit("none")) for d in dealt])


_CHOICES = """list_transform([0, 1, 2, 3], lambda i: coalesce(nullif(array_to_string(
    list_filter(string_split(text, ' '), lambda w, k: (k - 1) % 4 = i), ' '), ''), 'none'))"""


@register("build_prompts", "SELECT item_id, '" + parsing.MCQ_TEMPLATE.replace("{question}", "' || text || '")
          .replace("{choice1}", "' || c[1] || '").replace("{choice2}", "' || c[2] || '")
          .replace("{choice3}", "' || c[3] || '").replace("{choice4}", "' || c[4] || '")
          + f"' AS prompt FROM (SELECT *, {_CHOICES} AS c FROM benchmark)")
def build_prompts(spark, sf_dir):
    c = _choices(F.col("text"))
    prompt = parsing.build_prompt(
        parsing.MCQ_TEMPLATE, question=F.col("text"),
        **{f"choice{i + 1}": F.get(c, F.lit(i)) for i in range(4)},
    )
    return table(spark, sf_dir, "benchmark").select("item_id", prompt.alias("prompt"))


@register("shuffle_choices", f"""
WITH o AS (SELECT item_id, c[4] AS correct, list_transform(list_sort(list_transform(c,
    lambda x: {{'h': md5(concat_ws('|', item_id, x, '7')), 'c': x}})), lambda s: s.c) AS choices
  FROM (SELECT *, {_CHOICES} AS c FROM benchmark))
SELECT item_id, array_to_string(choices, '/') AS choices,
  '(' || substr('ABCDEFGHIJ', CAST(list_position(choices, correct) AS INT), 1) || ')' AS answer FROM o""")
def shuffle_choices(spark, sf_dir):
    c = _choices(F.col("text"))
    shuffled = parsing.shuffle_choices(F.col("item_id"), c, F.get(c, F.lit(3)), 7)
    return table(spark, sf_dir, "benchmark").select("item_id", shuffled.alias("s")).select(
        "item_id", F.array_join("s.choices", "/").alias("choices"), "s.answer"
    )


@register("split_reasoning", """
WITH t AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '<think>' || text || '</think>ok'
    WHEN 1 THEN '<think>' || text ELSE text END AS t FROM conversations)
SELECT conv_id, turn, md5(coalesce(nullif(regexp_extract(t, '(?s)<think>(.*?)</think>', 1), ''),
    nullif(regexp_extract(t, '(?s)<think>(.*)$', 1), ''), 'none')) AS reasoning,
  md5(trim(regexp_replace(regexp_replace(t, '(?s)<think>.*?</think>', '', 'g'), '(?s)<think>.*$', '', 'g'))) AS answer
FROM t""")
def split_reasoning(spark, sf_dir):
    kind = F.col("turn") % 3
    text = (
        F.when(kind == 0, F.concat(F.lit("<think>"), "text", F.lit("</think>ok")))
        .when(kind == 1, F.concat(F.lit("<think>"), "text"))
        .otherwise(F.col("text"))
    )
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", parsing.split_reasoning(text).alias("s")
    ).select(
        "conv_id", "turn", F.md5(F.coalesce("s.reasoning", F.lit("none"))).alias("reasoning"),
        F.md5("s.answer").alias("answer"),
    )


@register("classify_patch", """
SELECT CASE n_chars % 3 WHEN 0 THEN 'valid' WHEN 1 THEN 'garbage' ELSE 'empty' END AS kind,
  count(*) AS n FROM documents GROUP BY 1""")
def classify_patch(spark, sf_dir):
    n = F.col("n_chars") % 3
    patch = F.when(n == 0, F.concat(F.lit("diff --git a/x b/x\n"), "text")).when(
        n == 1, F.concat(F.lit("def x():\n"), "text")
    )
    return table(spark, sf_dir, "documents").groupBy(
        parsing.classify_patch(patch).alias("kind")
    ).agg(F.count(F.lit(1)).alias("n"))
