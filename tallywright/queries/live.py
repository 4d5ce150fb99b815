"""Streaming queries, each run to the end of its input and checked as a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywright.operators.running import time_chunk
from tallywright.queries.bindings import table, views
from tallywright.queries.records import _by_block, _progress_lines, _write_lines
from tallywright.queries.registry import register, rounded
from tallywright.streaming import health, metrics, verdicts
from tallywright.streaming.run import drain, latest_rows, read_stream

TIME = "yyyy-MM-dd HH:mm:ss"


def _events(spark, sf_dir):
    """The events table as a stream of metric samples."""
    raw = read_stream(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema)
    return raw.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("host"),
        F.col("event_type").alias("kind"),
        ((F.col("event_id") % 500) * 7).cast("double").alias("counter"),
    )


def _at(column):
    return F.date_format(column, TIME).alias(column)


_RATES = """WITH w AS (SELECT event_type AS kind, date_trunc('hour', ts) AS h,
    arg_min((event_id % 500) * 7.0, ts) AS f, arg_max((event_id % 500) * 7.0, ts) AS l,
    min((event_id % 500) * 7.0) AS mn, max((event_id % 500) * 7.0) AS mx, count(*) AS samples,
    (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 AS s FROM events GROUP BY ALL),
rates AS (SELECT kind, strftime(h, '%Y-%m-%d %H:%M:%S') AS window_start, samples,
  CAST(CASE WHEN mx > l THEN mx - f + l WHEN mn < f THEN l ELSE l - f END AS DOUBLE) AS growth, s FROM w)
"""


@register("counter_rate", _RATES + """
SELECT kind, window_start, samples, growth, CASE WHEN s > 0 THEN round(growth / s, 6) END AS rate FROM rates""")
def counter_rate(spark, sf_dir):
    rates = metrics.counter_rate(_events(spark, sf_dir), ["kind"], value="counter")
    out = latest_rows(spark, drain(rates, "update"), ["kind", "window_start"])
    return rounded(out.withColumn("window_start", _at("window_start")), rate=6)


@register("instant_vs_sustained", _RATES + """,
sustained AS (SELECT event_type AS kind, max((event_id % 500) * 7.0) / 3600 AS limit_rate FROM events GROUP BY event_type)
SELECT r.kind, r.window_start, CASE WHEN s > 0 THEN round(growth / s, 6) END AS rate,
  round(limit_rate, 6) AS sustained_rate, coalesce(CASE WHEN s > 0 THEN growth / s END > limit_rate, FALSE) AS overstated
FROM rates r JOIN sustained u ON u.kind = r.kind""")
def instant_vs_sustained(spark, sf_dir):
    sustained = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(
        (F.max((F.col("event_id") % 500) * 7).cast("double") / 3600).alias("sustained_rate")
    )
    rates = metrics.counter_rate(_events(spark, sf_dir), ["kind"], value="counter")
    flagged = metrics.instant_vs_sustained(rates, sustained, ["kind"])
    out = latest_rows(spark, drain(flagged, "update"), ["kind", "window_start"])
    out = out.select("kind", _at("window_start"), "rate", "sustained_rate", "overstated")
    return rounded(out, rate=6, sustained_rate=6)


@register("idle_gate", """
WITH s AS (SELECT event_type, user_id AS host, ts, date_trunc('hour', ts) AS h FROM events),
w AS (SELECT *, h AS w FROM s UNION ALL SELECT *, h - INTERVAL 1 HOUR FROM s)
SELECT host, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS samples,
  max(CASE WHEN event_type IN ('purchase', 'error') THEN 1 ELSE 0 END) = 0 AS idle
FROM w GROUP BY host, w""")
def idle_gate(spark, sf_dir):
    busy = F.when(F.col("kind").isin("purchase", "error"), 1).otherwise(0)
    gate = metrics.idle_gate(_events(spark, sf_dir), ["host"], busy)
    out = latest_rows(spark, drain(gate, "update"), ["host", "window_start"])
    return out.withColumn("window_start", _at("window_start"))


@register("wedge_detector", """
WITH m AS (SELECT user_id AS host, epoch_us(ts) // 60000000 AS slot,
    count(*) FILTER (WHERE event_type = 'error') AS failures, count(*) FILTER (WHERE event_type = 'view') AS answers,
    min(ts) FILTER (WHERE event_type = 'purchase') AS first_ok, max(ts) FILTER (WHERE event_type = 'purchase') AS last_ok,
    min(ts) FILTER (WHERE event_type = 'error') AS first_bad, max(ts) FILTER (WHERE event_type = 'error') AS last_bad
  FROM events GROUP BY ALL),
s AS (SELECT *, count(last_ok) OVER (PARTITION BY host ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM m),
sides AS (
  SELECT host, k, NULL AS after, NULL AS until, first_bad, last_bad, failures, answers FROM s WHERE last_ok IS NULL
  UNION ALL SELECT host, k, NULL, first_ok, CASE WHEN first_bad < first_ok THEN first_bad END,
    CASE WHEN first_bad < first_ok THEN first_bad END, 0, 0 FROM s WHERE last_ok IS NOT NULL
  UNION ALL SELECT host, k + 1, last_ok, NULL, CASE WHEN last_bad > last_ok THEN last_bad END,
    CASE WHEN last_bad > last_ok THEN last_bad END, 0, 0 FROM s WHERE last_ok IS NOT NULL),
g AS (SELECT host, max(after) AS after, min(until) AS until, min(first_bad) AS f, max(last_bad) AS t,
    CAST(sum(failures) AS BIGINT) AS failures, CAST(sum(answers) AS BIGINT) AS metadata_ok FROM sides GROUP BY host, k)
SELECT host, strftime(after, '%Y-%m-%d %H:%M:%S') AS after, strftime(until, '%Y-%m-%d %H:%M:%S') AS until,
  strftime(f, '%Y-%m-%d %H:%M:%S') AS first_failure, strftime(t, '%Y-%m-%d %H:%M:%S') AS last_failure, failures, metadata_ok
FROM g WHERE t IS NOT NULL AND metadata_ok > 0
  AND epoch_us(coalesce(until, t)) - epoch_us(coalesce(after, f)) >= 86400000000""")
def wedge_detector(spark, sf_dir):
    kind = F.col("kind")
    found = health.wedge_detector(
        _events(spark, sf_dir), "host", "ts", kind == "view", kind == "purchase",
        kind == "error", minutes=1440,
    )
    return found.withColumns({c: _at(c) for c in ("after", "until", "first_failure", "last_failure")})


@register("wedge_stretches", """
WITH s AS (SELECT user_id AS host, ts, event_type, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)
    OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS stretch FROM events),
g AS (SELECT host, min(ts) FILTER (WHERE event_type = 'error') AS f, max(ts) FILTER (WHERE event_type = 'error') AS t,
    count(*) FILTER (WHERE event_type = 'error') AS failures, count(*) FILTER (WHERE event_type = 'view') AS metadata_ok
  FROM s GROUP BY host, stretch)
SELECT host, strftime(f, '%Y-%m-%d %H:%M:%S') AS wedged_from, strftime(t, '%Y-%m-%d %H:%M:%S') AS wedged_to,
  failures, metadata_ok FROM g WHERE epoch_us(t) - epoch_us(f) >= 86400000000 AND metadata_ok > 0""")
def wedge_stretches(spark, sf_dir):
    probes = table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("host"),
        F.col("event_type").alias("kind"),
    )
    kind = F.col("kind")
    out = health.wedge_stretches(
        probes, "host", "ts", ["ts", "event_id"], time_chunk("ts"), kind == "view",
        kind == "purchase", kind == "error", minutes=1440,
    )
    return out.withColumn("wedged_from", _at("wedged_from")).withColumn("wedged_to", _at("wedged_to"))


@register("progress_stream", views("attempts") + """
SELECT CAST(attempt // 1000 AS INT) AS run, CAST(max(attempt % 1000) AS INT) AS done, 1000 AS total,
  max(CAST(status = 'F' AS INT)) AS ok, max(CAST(status = 'O' AS INT)) AS bad,
  max(CAST(status = 'P' AS INT)) AS error, CAST(max(60 + attempt % 60) AS INT) AS elapsed_s
FROM attempts GROUP BY attempt // 1000""")
def progress_stream(spark, sf_dir):
    folder = _write_lines(_by_block(_progress_lines(spark, sf_dir), "attempt"), "progress", "block")
    run = F.regexp_extract("file", "block=([0-9]+)", 1).cast("int")
    counters = verdicts.progress_stream(verdicts.progress_source(spark, folder), run)
    return latest_rows(spark, drain(counters, "update"), ["run"])


@register("ingest_results_stream", """
SELECT DISTINCT user_id AS model, event_type AS task, strftime(ts, '%Y-%m-%d') AS run_date FROM events""")
def ingest_results_stream(spark, sf_dir):
    rows = _events(spark, sf_dir).select(
        F.col("host").alias("model"), F.col("kind").alias("task"),
        F.date_format("ts", "yyyy-MM-dd").alias("run_date"), "ts", "event_id",
    )
    keys = ["model", "task", "run_date"]
    return verdicts.ingest_archive(rows, keys, ["ts", "event_id"]).select(*keys)


@register("late_segments", views("verd") +
          "SELECT system, instance, status, repo, n_attempts FROM verd")
def late_segments(spark, sf_dir):
    orders = read_stream(spark, f"{sf_dir}/orders.parquet", table(spark, sf_dir, "orders").schema)
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("instance"), F.col("c_mktsegment").alias("repo")
    )
    attempts = orders.select(
        F.col("o_orderpriority").alias("system"), F.col("o_custkey").alias("instance"),
        F.col("o_orderdate").cast("timestamp").alias("attempted_at"),
        F.col("o_orderkey").alias("attempt"), F.col("o_orderstatus").alias("status"),
    ).join(customers, "instance")
    return verdicts.late_segments(
        attempts, ["system", "instance"], ["attempted_at", "attempt"], ["status", "repo"]
    )


_RUNS = """
WITH g AS (SELECT user_id AS host, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS n
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(n) OVER (PARTITION BY host ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
r AS (SELECT host, min(ts) AS a, max(ts) + INTERVAL 12 HOUR AS b, count(*) AS events FROM s GROUP BY host, k)
"""


@register("table_sessions", _RUNS + """
SELECT host, strftime(a, '%Y-%m-%d %H:%M:%S') AS run_start, strftime(b, '%Y-%m-%d %H:%M:%S') AS run_end, events
FROM r""")
def table_sessions(spark, sf_dir):
    activity = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("host"), F.col("ts").cast("timestamp").alias("ts")
    )
    runs = metrics.table_sessions(activity, ["host"], gap_seconds=12 * 3600)
    return runs.select("host", _at("run_start"), _at("run_end"), "events")


@register("run_sessions", _RUNS + """
SELECT host, strftime(a, '%Y-%m-%d %H:%M:%S') AS run_start, strftime(b, '%Y-%m-%d %H:%M:%S') AS run_end, events
FROM r""")
def run_sessions(spark, sf_dir):
    found = metrics.archive_sessions(_events(spark, sf_dir), ["host"], gap="12 hours")
    return found.select("host", _at("run_start"), _at("run_end"), "events")
