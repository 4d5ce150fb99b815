"""Queries over requests, sweep levels, costs and configurations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywright.operators import comparison, contamination, sampling, throughput
from tallywright.queries.bindings import lvl, req, table, views
from tallywright.queries.registry import register, rounded

_W = "WINDOW w AS (PARTITION BY system ORDER BY concurrency)"


@register("exact_percentiles", views("req") + """
SELECT outcome, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50,
  round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99,
  round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std
FROM req GROUP BY outcome""")
def exact_percentiles(spark, sf_dir):
    out = throughput.latency_summary(req(spark, sf_dir), ["outcome"], "value")
    return rounded(out, p50=6, p90=6, p99=6, mean=6, std=6)


@register("index_percentiles", views("req", sorted="SELECT outcome, list_sort(list(value)) AS v FROM req GROUP BY outcome") + """
SELECT outcome, len(v) AS n, v[len(v) // 2 + 1] AS p50, v[CAST(floor(len(v) * 0.9) AS BIGINT) + 1] AS p90,
  v[1] AS min, v[len(v)] AS max FROM sorted""")
def index_percentiles(spark, sf_dir):
    return throughput.index_percentiles(req(spark, sf_dir), ["outcome"], "value")


@register("level_throughput", views("req", t="""SELECT outcome, count(*) AS completed,
    (max(end_us) - min(start_us)) / 1000000 AS duration_s, sum(out_tok) AS o, sum(in_tok) AS i
    FROM req GROUP BY outcome""") + """
SELECT outcome, completed, round(duration_s, 3) AS duration_s, round(o / duration_s, 6) AS out_tok_s,
  round((o + i) / duration_s, 6) AS total_tok_s, round(completed / duration_s, 6) AS req_s FROM t""")
def level_throughput(spark, sf_dir):
    out = throughput.level_throughput(req(spark, sf_dir), ["outcome"])
    return rounded(out, duration_s=3, out_tok_s=6, total_tok_s=6, req_s=6)


@register("request_latency", views("req", t="""SELECT system, value * 1000 AS e2e, value * 10 AS ttft,
    out_tok FROM req""") + """
SELECT system, count(*) AS n, round(avg(CASE WHEN out_tok > 1 THEN (e2e - ttft) / (out_tok - 1) END), 6) AS mean_tpot_ms,
  round(avg(ttft), 6) AS mean_ttft_ms, round(avg(out_tok * 1000 / nullif(e2e, 0)), 6) AS tok_s_per_user
FROM t GROUP BY system""")
def request_latency(spark, sf_dir):
    r = req(spark, sf_dir).select(
        "system", (F.col("value") * 1000).alias("e2e_ms"), (F.col("value") * 10).alias("ttft_ms"),
        "out_tok",
    )
    out = throughput.request_latency(r, ["system"])
    return rounded(out, mean_tpot_ms=6, mean_ttft_ms=6, tok_s_per_user=6)


@register("peak_rate", views("req", b="""SELECT outcome, date_trunc('hour', ts) AS h,
    CAST(sum(out_tok) AS BIGINT) AS t FROM req GROUP BY ALL""") + """
SELECT outcome, max(t) AS peak, count(*) AS busy_buckets FROM b GROUP BY outcome""")
def peak_rate(spark, sf_dir):
    return throughput.peak_rate(req(spark, sf_dir), ["outcome"], "ts", "out_tok", "1 hour")


@register("peak_concurrency", views("req", e="""SELECT outcome, t, sum(d) AS d FROM (
    SELECT outcome, start_us AS t, 1 AS d FROM req UNION ALL SELECT outcome, end_us, -1 FROM req)
    GROUP BY outcome, t""", r="SELECT outcome, sum(d) OVER (PARTITION BY outcome ORDER BY t) AS c FROM e") + """
SELECT outcome, CAST(max(c) AS BIGINT) AS peak_concurrency FROM r GROUP BY outcome""")
def peak_concurrency(spark, sf_dir):
    return throughput.peak_concurrency(req(spark, sf_dir), ["outcome"], "ts_start", "ts_end")


@register("overlap_contamination", views("req", runs="SELECT * FROM req WHERE outcome = 'purchase'",
    loads="SELECT * FROM req WHERE outcome <> 'purchase'") + """
SELECT r.system, r.event_id, count(l.event_id) AS n_overlaps,
  round(coalesce(sum(least(r.end_us, l.end_us) - greatest(r.start_us, l.start_us))
    FILTER (WHERE l.event_id IS NOT NULL), 0) / 1000000, 3) AS overlap_s
FROM runs r LEFT JOIN loads l ON l.system = r.system AND l.start_us < r.end_us AND l.end_us > r.start_us
GROUP BY r.system, r.event_id""")
def overlap_contamination(spark, sf_dir):
    r = req(spark, sf_dir)
    out = throughput.overlap_contamination(
        r.where(F.col("outcome") == "purchase"), r.where(F.col("outcome") != "purchase"),
        "system", "event_id", "ts_start", "ts_end",
    )
    return rounded(out, overlap_s=3)


@register("gain_vs_prev", views("gains") + """
SELECT system, concurrency, out_tok_s, round(gain, 6) AS gain FROM gains""")
def gain_vs_prev(spark, sf_dir):
    levels = lvl(spark, sf_dir).select("system", "concurrency", "out_tok_s")
    return rounded(throughput.gain_vs_prev(levels), gain=6)


@register("per_user_rate", views("gains") + """
SELECT system, concurrency, out_tok_s, round(out_tok_s / nullif(concurrency, 0), 6) AS tok_s_per_user FROM gains""")
def per_user_rate(spark, sf_dir):
    levels = lvl(spark, sf_dir).select("system", "concurrency", "out_tok_s")
    return rounded(throughput.per_user_rate(levels), tok_s_per_user=6)


@register("find_plateau", views("gains", m="""SELECT *, max(gain) OVER (PARTITION BY system
    ORDER BY concurrency ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM gains""") + """
SELECT system, min(concurrency) FILTER (WHERE gain IS NOT NULL AND rest < 0.02) AS plateau_level,
  arg_max(out_tok_s, concurrency) AS last_rate, max(out_tok_s) AS peak_rate,
  CASE WHEN count(*) FILTER (WHERE gain IS NOT NULL AND rest < 0.02) > 0 THEN 'plateau'
    ELSE 'still climbing' END AS state
FROM m GROUP BY system""")
def find_plateau(spark, sf_dir):
    return throughput.find_plateau(lvl(spark, sf_dir), threshold=0.02)


@register("flag_flat_spot", views("gains", m="""SELECT *, lag(gain) OVER w AS prev_gain,
    lead(gain) OVER w AS next_gain FROM gains """ + _W) + """
SELECT system, concurrency, round(gain, 6) AS gain,
  coalesce(gain < 0.005 AND next_gain >= 0.005 AND coalesce(prev_gain >= 0.005, TRUE), FALSE) AS flat_spot
FROM m""")
def flag_flat_spot(spark, sf_dir):
    out = throughput.flag_flat_spot(lvl(spark, sf_dir), threshold=0.005)
    return rounded(out.select("system", "concurrency", "gain", "flat_spot"), gain=6)


@register("flag_warmup", views("lvl", m="""SELECT *, lag(out_tok_s) OVER w AS b, lead(out_tok_s) OVER w AS a,
    lag(p99_ttft_ms) OVER w AS pb FROM lvl """ + _W) + """
SELECT system, concurrency, coalesce(out_tok_s < b AND a > b, FALSE) AS rebound,
  coalesce(p99_ttft_ms >= 1.0 * pb, FALSE) AS p99_spike,
  coalesce(out_tok_s < b AND a > b, FALSE) AND coalesce(p99_ttft_ms >= 1.0 * pb, FALSE) AS warmup
FROM m""")
def flag_warmup(spark, sf_dir):
    out = throughput.flag_warmup(lvl(spark, sf_dir), spike=1.0)
    return out.select("system", "concurrency", "rebound", "p99_spike", "warmup")


@register("at_matched_level", views("lvl") + """
SELECT o.system, o.concurrency, o.out_tok_s AS rate, r.out_tok_s AS reference_rate,
  round(o.out_tok_s / r.out_tok_s, 6) AS ratio
FROM lvl o JOIN lvl r ON r.system = 'A' AND o.system <> 'A' AND r.concurrency = o.concurrency""")
def at_matched_level(spark, sf_dir):
    return rounded(throughput.at_matched_level(lvl(spark, sf_dir), "A"), ratio=6)


@register("slo_operating_point", views("lvl") + """
SELECT system, max(concurrency) FILTER (WHERE tpot_ms < 102) AS operating_level,
  arg_max(out_tok_s, concurrency) FILTER (WHERE tpot_ms < 102) AS rate_at_slo,
  arg_max(tpot_ms, concurrency) FILTER (WHERE tpot_ms < 102) AS tpot_at_slo
FROM lvl GROUP BY system""")
def slo_operating_point(spark, sf_dir):
    return throughput.slo_operating_point(lvl(spark, sf_dir), slo=102.0)


@register("claim_type", views("lvl", m="""SELECT *, (lead(out_tok_s) OVER w - out_tok_s) / out_tok_s AS nxt,
    lead(ttft_ms) OVER w AS nt FROM lvl """ + _W,
    f="""SELECT system, min(concurrency) FILTER (WHERE nxt < 0.01 AND nt >= 1.0 * ttft_ms) AS stop,
    arg_max(concurrency, (out_tok_s, -concurrency)) AS top, max(out_tok_s) AS peak FROM m GROUP BY system""") + """
SELECT f.system, f.peak AS sustained_peak, f.top AS sustained_level,
  coalesce(l.out_tok_s, f.peak) AS practical_peak, coalesce(f.stop, f.top) AS practical_level,
  CASE WHEN f.stop IS NULL THEN 'same' ELSE 'practical below sustained' END AS claim
FROM f LEFT JOIN lvl l ON l.system = f.system AND l.concurrency = f.stop""")
def claim_type(spark, sf_dir):
    return throughput.claim_type(lvl(spark, sf_dir), threshold=0.01, cost=1.0)


@register("idle_before_level", views("lvl") + """
SELECT system, concurrency, CASE WHEN num_prompts % 3 = 0 THEN 'unknown'
  WHEN num_prompts % 3 = 1 THEN 'idle' ELSE 'busy' END AS start_state FROM lvl""")
def idle_before_level(spark, sf_dir):
    n = F.col("num_prompts") % 3
    levels = lvl(spark, sf_dir).withColumn("running_before", F.when(n != 0, (n - 1).cast("double")))
    return throughput.idle_before_level(levels, "running_before").select(
        "system", "concurrency", "start_state"
    )


@register("collapse_ratio", views("req", b="""SELECT outcome, epoch_us(ts) // 3600000000 AS slot,
    CAST(sum(out_tok) AS BIGINT) AS tokens FROM req GROUP BY ALL""",
    m="SELECT outcome, quantile_cont(tokens, 0.5) AS median FROM b GROUP BY outcome",
    gaps="SELECT outcome, slot + 1 AS slot, lead(slot) OVER (PARTITION BY outcome ORDER BY slot) - slot - 1 AS buckets FROM b",
    listed="""SELECT outcome, slot, 1 AS buckets, tokens FROM b
    UNION ALL SELECT outcome, slot, buckets, 0 FROM gaps WHERE buckets > 0""") + """
SELECT b.outcome, CAST(make_timestamp(b.slot * 3600000000) AS VARCHAR) AS bucket, CAST(b.buckets AS BIGINT) AS buckets, b.tokens,
  round(m.median, 6) AS median, round(m.median / nullif(b.tokens, 0), 6) AS times_below,
  b.tokens = 0 OR m.median / nullif(b.tokens, 0) >= 20 AS collapsed
FROM listed b JOIN m ON m.outcome = b.outcome""")
def collapse_ratio(spark, sf_dir):
    out = throughput.collapse_ratio(req(spark, sf_dir), ["outcome"], "ts", "out_tok", factor=20.0)
    out = out.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH:mm:ss"))
    return rounded(out, median=6, times_below=6)


@register("order_levels", views("lvl") + "SELECT system, concurrency, out_tok_s FROM lvl ORDER BY 1, 2")
def order_levels(spark, sf_dir):
    return sampling.order_levels(lvl(spark, sf_dir).select("system", "concurrency", "out_tok_s"))


@register("top_k", """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10""")
def top_k(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return sampling.top_k(items, "l_extendedprice", 10, ["l_orderkey", "l_linenumber"])


@register("probe", views("req", p="SELECT value FROM req ORDER BY event_id LIMIT 50") + """
SELECT (SELECT count(*) FROM p) AS probed, (SELECT count(*) FROM req) AS items,
  (SELECT round(avg(value), 6) FROM p) AS mean_seconds,
  round((SELECT avg(value) FROM p) * (SELECT count(*) FROM req) / 3600, 6) AS projected_hours""")
def probe(spark, sf_dir):
    out = sampling.probe(req(spark, sf_dir), "event_id", "value", 50)
    return rounded(out, mean_seconds=6, projected_hours=6)


@register("token_usage", views("req") + """
SELECT outcome, grouping(outcome) = 1 AS is_total, count(*) AS requests, CAST(sum(in_tok) AS BIGINT) AS in_tokens,
  CAST(sum(out_tok) AS BIGINT) AS out_tokens, CAST(sum(in_tok) + sum(out_tok) AS BIGINT) AS total_tokens
FROM req GROUP BY ROLLUP (outcome)""")
def token_usage(spark, sf_dir):
    return comparison.token_usage(req(spark, sf_dir), "outcome", "in_tok", "out_tok")


@register("eval_cost", views("req") + """
SELECT system, outcome, count(*) AS items, round(avg(value), 6) AS seconds_per_item,
  round(sum(value) / 3600, 6) AS hours FROM req GROUP BY system, outcome""")
def eval_cost(spark, sf_dir):
    out = comparison.eval_cost(req(spark, sf_dir), ["system", "outcome"], "value")
    return rounded(out, seconds_per_item=6, hours=6)


@register("reconcile", views("lvl", claims="""SELECT system, concurrency, round(out_tok_s, -1) AS claimed
    FROM lvl WHERE num_prompts % 4 <> 0""", measured="SELECT * FROM lvl WHERE num_prompts % 5 <> 0") + """
SELECT coalesce(c.system, m.system) AS system, coalesce(c.concurrency, m.concurrency) AS concurrency,
  c.claimed, m.out_tok_s AS measured,
  CASE WHEN c.claimed IS NULL THEN 'not claimed' WHEN m.out_tok_s IS NULL THEN 'not measured'
    WHEN abs(c.claimed - m.out_tok_s) > 2 THEN 'differs' ELSE 'agrees' END AS status
FROM claims c FULL JOIN measured m ON m.system = c.system AND m.concurrency = c.concurrency""")
def reconcile(spark, sf_dir):
    levels = lvl(spark, sf_dir)
    claims = levels.where(F.col("num_prompts") % 4 != 0).select(
        "system", "concurrency", F.round("out_tok_s", -1).alias("out_tok_s")
    )
    measured = levels.where(F.col("num_prompts") % 5 != 0)
    return comparison.reconcile(claims, measured, ["system", "concurrency"], "out_tok_s", 2.0)


@register("fits_memory", """
WITH models AS (SELECT p_partkey, p_size * CAST(CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 0.5
    WHEN p_type IN ('STANDARD', 'MEDIUM') THEN 1.0 ELSE 2.0 END AS DOUBLE) + 5 AS need_gb FROM part),
hosts AS (SELECT s_acctbal / 80 AS usable FROM supplier WHERE s_acctbal >= 0)
SELECT p_partkey, round(need_gb, 1) AS need_gb,
  (SELECT round(min(usable), 6) FROM hosts WHERE usable >= need_gb) AS smallest_fit_gb,
  (SELECT count(*) FROM hosts WHERE usable >= need_gb) AS n_hosts,
  (SELECT count(*) FROM hosts WHERE usable >= need_gb) > 0 AS fits
FROM models""")
def fits_memory(spark, sf_dir):
    kind = F.col("p_type")
    quant = F.when(kind.isin("ECONOMY", "SMALL"), "NVFP4").when(
        kind.isin("STANDARD", "MEDIUM"), "FP8"
    ).otherwise("BF16")
    models = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.round(comparison.memory_need_gb(F.col("p_size").cast("double"), quant), 1).alias("need_gb"),
    )
    hosts = table(spark, sf_dir, "supplier").select((F.col("s_acctbal") / 80).alias("usable_gb"))
    return rounded(comparison.fits_memory(models, hosts, "need_gb", "usable_gb"), smallest_fit_gb=6)


def _configs(spark, sf_dir):
    """One settings map per sweep system."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_returnflag").alias("system"))
        .agg(
            F.max("l_linenumber").cast("string").alias("a"),
            F.max("l_tax").cast("string").alias("b"),
            F.max("l_orderkey").cast("string").alias("c"),
            F.min("l_linestatus").alias("d"),
            F.count(F.lit(1)).cast("string").alias("e"),
        )
        .select(
            "system",
            F.map_filter(
                F.create_map(
                    F.lit("max_level"), "a", F.lit("temperature"), "b", F.lit("budget"), "c",
                    F.lit("filter"), "d", F.lit("harness"), "e",
                    F.lit("only_first"), F.when(F.col("system") == "A", "yes"),
                ),
                lambda k, v: v.isNotNull(),
            ).alias("config"),
        )
    )


_CONFIGS = """WITH c AS (SELECT l_returnflag AS system, CAST(max(l_linenumber) AS VARCHAR) AS a,
  CAST(max(l_tax) AS VARCHAR) AS b, CAST(max(l_orderkey) AS VARCHAR) AS c, min(l_linestatus) AS d,
  CAST(count(*) AS VARCHAR) AS e FROM lineitem GROUP BY l_returnflag),
kv AS (SELECT system, 'max_level' AS key, a AS value FROM c UNION ALL SELECT system, 'temperature', b FROM c
  UNION ALL SELECT system, 'budget', c FROM c UNION ALL SELECT system, 'filter', d FROM c
  UNION ALL SELECT system, 'harness', e FROM c
  UNION ALL SELECT system, 'only_first', 'yes' FROM c WHERE system = 'A'),
cells AS (SELECT s.system, k.key, o.value, r.value AS reference
  FROM (SELECT DISTINCT system FROM kv WHERE system <> 'A') s, (SELECT DISTINCT key FROM kv) k
  LEFT JOIN kv o ON o.system = s.system AND o.key = k.key LEFT JOIN kv r ON r.system = 'A' AND r.key = k.key)
"""


@register("comparability_check", _CONFIGS +
          "SELECT * FROM cells WHERE value IS DISTINCT FROM reference")
def comparability_check(spark, sf_dir):
    return comparison.comparability_check(_configs(spark, sf_dir), "A").select(
        "system", "key", "value", "reference"
    )


@register("comparable_systems", _CONFIGS + """
SELECT system, count(*) FILTER (WHERE value IS DISTINCT FROM reference) AS n_differences,
  count(*) FILTER (WHERE value IS DISTINCT FROM reference) = 0 AS comparable
FROM cells GROUP BY system""")
def comparable_systems(spark, sf_dir):
    return comparison.comparable_systems(_configs(spark, sf_dir), "A")


@register("config_diff", """
WITH last_k AS (SELECT user_id, event_type, arg_max(regexp_extract(props, '([0-9]+)', 1), event_id) AS v
  FROM events GROUP BY user_id, event_type)
SELECT event_type AS key, count(DISTINCT v) AS n_values,
  (SELECT count(DISTINCT user_id) FROM events) - count(DISTINCT user_id) AS n_without_key
FROM last_k GROUP BY event_type
HAVING count(DISTINCT v) > 1 OR (SELECT count(DISTINCT user_id) FROM events) > count(DISTINCT user_id)""")
def config_diff(spark, sf_dir):
    return comparison.config_diff(_event_configs(spark, sf_dir))


def _event_configs(spark, sf_dir):
    props = F.from_json("props", "map<string,string>")
    last = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run"), "event_type").agg(
        F.max_by(F.try_element_at(props, F.lit("k")), "event_id").alias("v")
    )
    return last.select("run", F.create_map("event_type", "v").alias("config"))


@register("config_values", """
WITH last_k AS (SELECT user_id, event_type, arg_max(regexp_extract(props, '([0-9]+)', 1), event_id) AS v
  FROM events GROUP BY user_id, event_type),
d AS (SELECT event_type, (SELECT count(DISTINCT user_id) FROM events) - count(DISTINCT user_id) AS without
  FROM last_k GROUP BY event_type HAVING count(DISTINCT v) > 1 OR (SELECT count(DISTINCT user_id) FROM events) > count(DISTINCT user_id))
SELECT event_type AS key, v AS value, count(DISTINCT user_id) AS n_runs FROM last_k JOIN d USING (event_type) GROUP BY ALL
UNION ALL SELECT event_type, NULL, without FROM d WHERE without > 0""")
def config_values(spark, sf_dir):
    return comparison.config_values(_event_configs(spark, sf_dir))


_GRAMS = """WITH words AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \\t\\r\\n]+'),
    lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[ \\t\\r\\n]+'), lambda x: x <> '') AS w
  FROM benchmark),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 11),
    lambda i: array_to_string(w[i:i + 12], ' '))) AS gram FROM words WHERE len(w) >= 13),
ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 11),
    lambda i: array_to_string(w[i:i + 12], ' '))) AS gram FROM iw WHERE len(w) >= 13)
""".replace("\\\\", "\\")


@register("contamination_items", _GRAMS + """
SELECT item_id, count(*) AS n_grams, count(d.gram) AS n_found, round(count(d.gram) / count(*), 6) AS share
FROM ig LEFT JOIN (SELECT DISTINCT gram FROM dg) d ON d.gram = ig.gram GROUP BY item_id""")
def contamination_items(spark, sf_dir):
    out = contamination.item_contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id"
    )
    return rounded(out, share=6)


@register("contamination_documents", _GRAMS + """
SELECT doc_id, count(*) AS n_hits FROM dg WHERE gram IN (SELECT gram FROM ig) GROUP BY doc_id""")
def contamination_documents(spark, sf_dir):
    return contamination.document_contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id"
    )
