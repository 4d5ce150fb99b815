"""Deterministic views that read the shared tables as benchmark records.

Each view exists twice, as a DataFrame and as a SQL common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.operators import scoring, verdicts

LANGS = ["de", "en", "es", "fr"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def resp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses: documents with an answer line; some have no content at all."""
    n = F.col("n_chars")
    letter = F.substr(F.lit("ABCD"), (n % 4).cast("int") + 1, F.lit(1))
    gold = F.substr(F.lit("ABCD"), (n % 3).cast("int") + 1, F.lit(1))
    content = F.when(
        n % 7 != 0, F.concat(F.col("text"), F.lit(" The answer is ("), letter, F.lit(")"))
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("source").alias("system"),
        F.col("lang").alias("task"),
        "n_chars",
        content.alias("content"),
        gold.alias("gold"),
        F.when(n % 7 == 0, "length").otherwise("stop").alias("finish_reason"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_responses(resp(spark, sf_dir))


def score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_summary(scored(spark, sf_dir), ["system", "task"], "ok_line")


def req(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests: events with a start, an end, and token counts."""
    ts = F.col("ts").cast("timestamp")
    centi = F.round(F.col("value") * 100).cast("bigint")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("system"),
        F.col("event_type").alias("outcome"),
        "value",
        ts.alias("ts"),
        ts.alias("ts_start"),
        F.timestamp_micros(F.unix_micros(ts) + centi * 6_000_000).alias("ts_end"),
        k.alias("in_tok"),
        (k * 2 + 1).alias("out_tok"),
    )


def verd_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts: one order is one attempt of a customer's item by a priority's system."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("system"),
        F.col("o_custkey").alias("instance"),
        F.col("o_orderdate").cast("timestamp").alias("attempted_at"),
        F.col("o_orderkey").alias("attempt"),
        F.col("o_orderstatus").alias("status"),
    )
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("instance"), F.col("c_mktsegment").alias("repo")
    )
    return orders.join(customers, "instance")


def verd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final verdicts: the latest attempt per system and item."""
    last = verdicts.last_status_wins(
        verd_attempts(spark, sf_dir), ["system", "instance"], ["attempted_at", "attempt"],
        ["status", "repo"],
    )
    return last.withColumn("resolved", F.col("status") == "F")


def lvl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sweep levels: line items by return flag (system) and line number (level)."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_returnflag").alias("system"), F.col("l_linenumber").alias("concurrency")
        )
        .agg(
            F.round(F.sum("l_quantity") / 100, 2).alias("out_tok_s"),
            F.round(F.avg("l_extendedprice") / 100, 2).alias("ttft_ms"),
            F.round(F.max(F.col("l_extendedprice") * (1 + F.col("l_tax"))) / 100, 2).alias(
                "p99_ttft_ms"
            ),
            F.round(F.avg("l_quantity") * 4, 2).alias("tpot_ms"),
            F.count(F.lit(1)).alias("num_prompts"),
        )
    )


def cand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates: the line items of an order compete by price."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("problem"),
        F.col("l_linenumber").alias("candidate"),
        F.col("l_extendedprice").alias("score"),
        F.col("l_quantity").alias("quantity"),
    )


MCQ = r"[Tt]he answer is \(?([A-D])\)?"

_CTES = {
    "resp": """resp AS (
  SELECT doc_id, source AS system, lang AS task, n_chars,
    CASE WHEN n_chars % 7 <> 0 THEN text || ' The answer is (' ||
      substr('ABCD', CAST(n_chars % 4 AS INT) + 1, 1) || ')' END AS content,
    substr('ABCD', CAST(n_chars % 3 AS INT) + 1, 1) AS gold,
    CASE WHEN n_chars % 7 = 0 THEN 'length' ELSE 'stop' END AS finish_reason
  FROM documents)""",
    "scored": rf"""preds AS (
  SELECT *,
    list_extract(regexp_extract_all(coalesce(content, ''), '{MCQ}', 1), -1) AS pred_line,
    list_extract(regexp_extract_all(coalesce(content, ''), '\(([A-D])\)', 1), -1) AS pred_fallback
  FROM resp),
scored AS (
  SELECT *, coalesce(lower(pred_line) = lower(gold), FALSE) AS ok_line,
    coalesce(lower(pred_fallback) = lower(gold), FALSE) AS ok_fallback
  FROM preds)""",
    "scores": """scores AS (
  SELECT system, task, count(*) AS n, CAST(count(*) FILTER (WHERE ok_line) AS BIGINT) AS n_correct,
    count(*) FILTER (WHERE ok_line) / count(*) AS score
  FROM scored GROUP BY system, task)""",
    "req": """req AS (
  SELECT event_id, user_id AS system, event_type AS outcome, value, ts,
    epoch_us(ts) AS start_us,
    epoch_us(ts) + CAST(round(value * 100) AS BIGINT) * 6000000 AS end_us,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS in_tok,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * 2 + 1 AS out_tok
  FROM events)""",
    "attempts": """attempts AS (
  SELECT o_orderpriority AS system, o_custkey AS instance, o_orderdate AS attempted_at,
    o_orderkey AS attempt, o_orderstatus AS status, c_mktsegment AS repo
  FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "verd": """ranked_attempts AS (
  SELECT *, row_number() OVER (PARTITION BY system, instance ORDER BY attempted_at DESC, attempt DESC) AS rn,
    count(*) OVER (PARTITION BY system, instance) AS n_attempts
  FROM attempts),
verd AS (
  SELECT system, instance, status, repo, n_attempts, status = 'F' AS resolved
  FROM ranked_attempts WHERE rn = 1)""",
    "lvl": """lvl AS (
  SELECT l_returnflag AS system, l_linenumber AS concurrency,
    round(sum(l_quantity) / 100, 2) AS out_tok_s,
    round(avg(l_extendedprice) / 100, 2) AS ttft_ms,
    round(max(l_extendedprice * (1 + l_tax)) / 100, 2) AS p99_ttft_ms,
    round(avg(l_quantity) * 4, 2) AS tpot_ms,
    count(*) AS num_prompts
  FROM lineitem GROUP BY ALL)""",
    "gains": """gains AS (
  SELECT *, (out_tok_s - lag(out_tok_s) OVER w) / lag(out_tok_s) OVER w AS gain
  FROM lvl WINDOW w AS (PARTITION BY system ORDER BY concurrency))""",
    "cand": """cand AS (
  SELECT l_orderkey AS problem, l_linenumber AS candidate, l_extendedprice AS score,
    l_quantity AS quantity
  FROM lineitem)""",
}
_NEEDS = {"scored": ["resp"], "scores": ["resp", "scored"], "verd": ["attempts"],
          "gains": ["lvl"]}


def views(*names: str, **extra: str) -> str:
    """``WITH`` clause that defines the named views, then extra ones in order."""
    wanted: list[str] = []
    for name in names:
        for need in [*_NEEDS.get(name, []), name]:
            if need not in wanted:
                wanted.append(need)
    parts = [_CTES[name] for name in wanted] + [f"{k} AS ({v})" for k, v in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n"
