"""Queries over attempts, verdicts and best-of-N candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywright.operators import attempts, comparison, running, sampling, scoring, trust, verdicts
from tallywright.queries.bindings import cand, req, table, verd, verd_attempts, views
from tallywright.queries.registry import register, rounded

STATUSES = ["F", "O", "P"]
STATUS_CLASS = {"F": "model", "O": "agent-budget", "P": "infra"}


@register("last_status_wins", views("verd") +
          "SELECT system, instance, status, repo, n_attempts FROM verd")
def last_status_wins(spark, sf_dir):
    return verdicts.last_status_wins(
        verd_attempts(spark, sf_dir), ["system", "instance"], ["attempted_at", "attempt"],
        ["status", "repo"],
    )


@register("distinct_instances", views("attempts") +
          "SELECT DISTINCT system, instance FROM attempts")
def distinct_instances(spark, sf_dir):
    return verdicts.distinct_instances(verd_attempts(spark, sf_dir), ["system", "instance"])


@register("union_segments", views("attempts") + """
SELECT segment, count(*) AS n, count(status) AS n_status, count(repo) AS n_repo FROM (
  SELECT 'initial' AS segment, status, NULL AS repo FROM attempts WHERE status = 'F'
  UNION ALL SELECT 'resume', status, repo FROM attempts WHERE status <> 'F')
GROUP BY segment""")
def union_segments(spark, sf_dir):
    a = verd_attempts(spark, sf_dir)
    both = verdicts.union_segments(
        ("initial", a.where(F.col("status") == "F").select("instance", "status")),
        ("resume", a.where(F.col("status") != "F").select("instance", "status", "repo")),
    )
    return both.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"), F.count("status").alias("n_status"),
        F.count("repo").alias("n_repo"),
    )


@register("merge_reruns", views("attempts", base="""SELECT system, instance,
    arg_min(status, (attempted_at, attempt)) AS status FROM attempts GROUP BY ALL""",
    replay="""SELECT system, instance, arg_max(status, (attempted_at, attempt)) AS status
    FROM attempts WHERE status <> 'P' GROUP BY ALL""") + """
SELECT b.system, b.instance, coalesce(r.status, b.status) AS status,
  CASE WHEN r.status IS NULL THEN 'base' ELSE 'replay' END AS source
FROM base b LEFT JOIN replay r ON r.system = b.system AND r.instance = b.instance""")
def merge_reruns(spark, sf_dir):
    a = verd_attempts(spark, sf_dir)
    keys, order = ["system", "instance"], F.struct("attempted_at", "attempt")
    base = a.groupBy(*keys).agg(F.min_by("status", order).alias("status"))
    replay = a.where(F.col("status") != "P").groupBy(*keys).agg(
        F.max_by("status", order).alias("status")
    )
    return verdicts.merge_reruns(base, replay, keys, ["status"])


@register("resume_worklist", """
SELECT c_custkey AS instance, c_mktsegment AS repo FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def resume_worklist(spark, sf_dir):
    items = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("instance"), F.col("c_mktsegment").alias("repo")
    )
    done = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F").select(
        F.col("o_custkey").alias("instance")
    )
    return verdicts.resume_worklist(items, done, ["instance"])


@register("resolve_by_repo", views("verd") + """
SELECT system, coalesce(repo, 'TOTAL') AS repo,
  CAST(count(*) FILTER (WHERE resolved) AS BIGINT) AS resolved, count(*) AS attempted,
  round(count(*) FILTER (WHERE resolved) / count(*), 6) AS rate
FROM verd GROUP BY GROUPING SETS ((system, repo), (system))""")
def resolve_by_repo(spark, sf_dir):
    out = verdicts.resolve_by_repo(verd(spark, sf_dir), "resolved", by=["system"])
    return rounded(out, rate=6)


@register("status_counts", views("verd") + "SELECT system, " + ", ".join(
    f"count(*) FILTER (WHERE status = '{s}') AS n_{s.lower()}" for s in STATUSES[:2]
) + ", count(*) FILTER (WHERE status NOT IN ('F', 'O')) AS n_other FROM verd GROUP BY system")
def status_counts(spark, sf_dir):
    return verdicts.status_counts(verd(spark, sf_dir), ["system"], "status", STATUSES[:2])


@register("coverage", views("verd", per="""SELECT system, repo, count(DISTINCT instance) AS n
    FROM verd GROUP BY ALL""") + """
SELECT system, count(*) AS n_repos, CAST(sum(n) AS BIGINT) AS n_instances,
  round(max(n) / sum(n), 6) AS largest_share FROM per GROUP BY system""")
def coverage(spark, sf_dir):
    out = verdicts.coverage(verd(spark, sf_dir), ["system"], "repo", "instance")
    return rounded(out, largest_share=6)


@register("pass_count", views("verd") + """
SELECT system, repo, count(*) FILTER (WHERE resolved) AS passed, count(*) AS total,
  count(*) FILTER (WHERE resolved) || '/' || count(*) || ' passed' AS label
FROM verd GROUP BY system, repo""")
def pass_count(spark, sf_dir):
    return verdicts.pass_count(verd(spark, sf_dir), ["system", "repo"], "resolved")


@register("failures", views("verd") + "SELECT system, instance FROM verd WHERE NOT resolved")
def failures(spark, sf_dir):
    return verdicts.failures(verd(spark, sf_dir), ["system", "instance"], "resolved")


@register("head_to_head", views("verd") + """
SELECT o.system, count(*) AS shared, count(*) FILTER (WHERE o.resolved AND r.resolved) AS both,
  count(*) FILTER (WHERE o.resolved AND NOT r.resolved) AS system_only,
  count(*) FILTER (WHERE NOT o.resolved AND r.resolved) AS reference_only,
  count(*) FILTER (WHERE NOT o.resolved AND NOT r.resolved) AS neither
FROM verd o JOIN verd r ON r.system = '1-URGENT' AND o.system <> '1-URGENT' AND o.instance = r.instance
GROUP BY o.system""")
def head_to_head(spark, sf_dir):
    return verdicts.head_to_head(
        verd(spark, sf_dir), "1-URGENT", "system", "instance", "resolved"
    )


@register("failure_overlap", views("verd", f="""SELECT instance,
    string_agg(system, ',' ORDER BY system) AS failed_by FROM verd WHERE NOT resolved GROUP BY instance""") + """
SELECT failed_by, count(*) AS n_instances FROM f GROUP BY failed_by""")
def failure_overlap(spark, sf_dir):
    return verdicts.failure_overlap(verd(spark, sf_dir), "system", "instance", "resolved")


@register("same_sample", views("verd", a="SELECT instance FROM verd WHERE system = '1-URGENT'",
                               b="SELECT instance FROM verd WHERE system = '2-HIGH'") + """
SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS shared,
  (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_a,
  (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_b,
  FALSE AS identical""")
def same_sample(spark, sf_dir):
    v = verd(spark, sf_dir)
    return verdicts.same_sample(
        v.where(F.col("system") == "1-URGENT"), v.where(F.col("system") == "2-HIGH"), ["instance"]
    )


@register("shared_instances", views("verd") + """
SELECT count(*) AS n_shared, CAST(count(*) FILTER (WHERE a.resolved) AS BIGINT) AS resolved_a,
  CAST(count(*) FILTER (WHERE b.resolved) AS BIGINT) AS resolved_b
FROM verd a JOIN verd b ON a.instance = b.instance
WHERE a.system = '3-MEDIUM' AND b.system = '5-LOW'""")
def shared_instances(spark, sf_dir):
    return verdicts.shared_instances(
        verd(spark, sf_dir), "3-MEDIUM", "5-LOW", "system", "instance", "resolved"
    )


@register("classify_failure", views("verd") + """
SELECT system, CASE status WHEN 'F' THEN 'model' WHEN 'O' THEN 'agent-budget' WHEN 'P' THEN 'infra' END
  AS failure_class, count(*) AS n FROM verd GROUP BY ALL""")
def classify_failure(spark, sf_dir):
    return trust.classify_failures(verd(spark, sf_dir), ["system"], "status", STATUS_CLASS)


@register("zero_score_rule", views("verd", s="""SELECT system, repo,
    count(*) FILTER (WHERE status = 'P') / count(*) AS score FROM verd GROUP BY ALL""",
    b="SELECT repo, avg(CAST(status <> 'P' AS INT)) AS baseline FROM verd WHERE repo <> 'MACHINERY' GROUP BY repo") + """
SELECT s.system, s.repo, round(s.score, 6) AS score, round(b.baseline, 6) AS baseline,
  CASE WHEN b.baseline IS NULL THEN 'no baseline'
    WHEN b.baseline >= 0.5 AND s.score <= 0.48 * b.baseline THEN 'infra failure' ELSE 'result' END AS verdict
FROM s LEFT JOIN b ON b.repo = s.repo""")
def zero_score_rule(spark, sf_dir):
    v = verd(spark, sf_dir)
    scores = v.groupBy("system", "repo").agg(
        (F.count_if(F.col("status") == "P") / F.count(F.lit(1))).alias("score")
    )
    baseline = v.where(F.col("repo") != "MACHINERY").groupBy("repo").agg(
        F.avg((F.col("status") != "P").cast("int")).alias("score")
    )
    out = trust.zero_score_rule(scores, baseline, ["repo"], collapse=0.48)
    return rounded(out.select("system", "repo", "score", "baseline", "verdict"), score=6, baseline=6)


def _instances(spark, sf_dir):
    """Grader statuses from verdicts; items tried once count as incomplete when open."""
    status = (
        F.when(F.col("status") == "F", "resolved")
        .when((F.col("status") == "O") & (F.col("n_attempts") == 1), "incomplete")
        .when(F.col("status") == "O", "unresolved")
        .when(F.col("n_attempts") % 2 == 0, "empty_patch")
        .otherwise("error")
    )
    return verd(spark, sf_dir).select("system", "instance", status.alias("status"))


_INSTANCES = views("verd", instances="""SELECT system, instance, CASE WHEN status = 'F' THEN 'resolved'
    WHEN status = 'O' AND n_attempts = 1 THEN 'incomplete' WHEN status = 'O' THEN 'unresolved'
    WHEN n_attempts % 2 = 0 THEN 'empty_patch' ELSE 'error' END AS status FROM verd""")


@register("conservation_checks", _INSTANCES + """
SELECT system, count(*) AS total, count(*) FILTER (WHERE status <> 'incomplete') AS submitted,
  count(*) FILTER (WHERE status IN ('resolved', 'unresolved')) AS completed,
  count(*) FILTER (WHERE status = 'resolved') AS resolved,
  count(*) FILTER (WHERE status = 'unresolved') AS unresolved,
  count(*) FILTER (WHERE status = 'empty_patch') AS empty_patch,
  count(*) FILTER (WHERE status = 'error') AS error,
  count(*) FILTER (WHERE status = 'incomplete') AS incomplete,
  TRUE AS submitted_ok, TRUE AS completed_ok, TRUE AS total_ok, TRUE AS conserved
FROM instances GROUP BY system""")
def conservation_checks(spark, sf_dir):
    return trust.conservation_checks(trust.report_counts(_instances(spark, sf_dir), ["system"]))


@register("clean_run_gate", _INSTANCES + """
SELECT system, count(*) AS n, count(*) FILTER (WHERE status = 'error') AS harness_errors,
  round(avg(CASE WHEN status IN ('resolved', 'unresolved') THEN 1 ELSE 0 END), 6) AS verdict_share,
  count(*) FILTER (WHERE status = 'error') = 0
    AND avg(CASE WHEN status IN ('resolved', 'unresolved') THEN 1 ELSE 0 END) >= 0.5 AS clean
FROM instances GROUP BY system""")
def clean_run_gate(spark, sf_dir):
    out = trust.clean_run_gate(
        _instances(spark, sf_dir), ["system"], F.col("status") == "error",
        F.col("status").isin("resolved", "unresolved"), 0.5,
    )
    return rounded(out, verdict_share=6)


@register("running_verdicts", views("attempts") + """
SELECT system, attempt, CAST(sum(CAST(status = 'F' AS INT)) OVER w AS BIGINT) AS ok,
  CAST(sum(CAST(status = 'O' AS INT)) OVER w AS BIGINT) AS bad,
  CAST(sum(CAST(status = 'P' AS INT)) OVER w AS BIGINT) AS error
FROM attempts WINDOW w AS (PARTITION BY system ORDER BY attempted_at, attempt
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_verdicts(spark, sf_dir):
    status = F.col("status")
    out = running.running_verdicts(
        verd_attempts(spark, sf_dir), ["system"], ["attempted_at", "attempt"],
        running.time_chunk("attempted_at", 30 * 86400),
        {"ok": status == "F", "bad": status == "O", "error": status == "P"},
    )
    return out.select("system", "attempt", "ok", "bad", "error")


@register("carry_header", views("req") + """
SELECT system, event_id, last_value(CASE WHEN outcome = 'signup' THEN event_id END IGNORE NULLS)
  OVER (PARTITION BY system ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS header
FROM req""")
def carry_header(spark, sf_dir):
    header = F.when(F.col("outcome") == "signup", F.col("event_id"))
    out = running.carry_header(
        req(spark, sf_dir), ["system"], ["ts", "event_id"], running.time_chunk("ts"), header
    )
    return out.select("system", "event_id", "header")


@register("segment_id", views("req") + """
SELECT system, event_id, CAST(sum(CASE WHEN outcome = 'signup' THEN 1 ELSE 0 END)
  OVER (PARTITION BY system ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment
FROM req""")
def segment_id(spark, sf_dir):
    out = running.segment_id(
        req(spark, sf_dir), ["system"], ["ts", "event_id"], running.time_chunk("ts"),
        F.col("outcome") == "signup",
    )
    return out.select("system", "event_id", "segment")


@register("pick_champion", views("cand") + """
SELECT problem, arg_max(candidate, (score, -candidate)) AS champion, max(score) AS best_score,
  count(score) AS n_scored FROM cand GROUP BY problem""")
def pick_champion(spark, sf_dir):
    return attempts.pick_champion(cand(spark, sf_dir), ["problem"], "candidate", "score")


@register("round_progress", views("cand", rounds="""SELECT problem, candidate AS round,
    max(score) AS score, max(quantity) AS quantity FROM cand GROUP BY ALL""") + """
SELECT problem, min(round) FILTER (WHERE quantity > 25) AS rounds_to_green, max(round) AS last_round,
  arg_min(score, round) AS first_value, arg_max(score, round) AS last_value,
  round(arg_max(score, round) / arg_min(score, round), 6) AS improvement
FROM rounds GROUP BY problem""")
def round_progress(spark, sf_dir):
    rounds = cand(spark, sf_dir).groupBy("problem", F.col("candidate").alias("round")).agg(
        F.max("score").alias("score"), F.max("quantity").alias("quantity")
    )
    out = attempts.round_progress(rounds, ["problem"], "round", "score", F.col("quantity") > 25)
    return rounded(out, improvement=6)


@register("work_before_abort", views("req", firsts="""SELECT system,
    min((ts, event_id)) AS first_error FROM req WHERE outcome = 'error' GROUP BY system""",
    steps="""SELECT f.system, count(r.event_id) AS steps FROM firsts f
    LEFT JOIN req r ON r.system = f.system AND (r.ts, r.event_id) < f.first_error GROUP BY f.system""") + """
SELECT count(*) AS aborted, round(quantile_cont(steps, 0.5), 6) AS median_steps,
  count(*) FILTER (WHERE steps >= 3) AS working FROM steps""")
def work_before_abort(spark, sf_dir):
    out = attempts.work_before_abort(
        req(spark, sf_dir), ["system"], ["ts", "event_id"], running.time_chunk("ts"),
        F.col("outcome") == "error",
    )
    return rounded(out, median_steps=6)


@register("seeded_sample", """
SELECT o_orderkey, o_custkey FROM orders
ORDER BY md5(o_orderkey || '|42'), o_orderkey LIMIT 100""")
def seeded_sample(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return sampling.seeded_sample(orders, "o_orderkey", 100, 42)


@register("slice_bias", views("attempts", items="SELECT DISTINCT instance, repo FROM attempts",
    first="SELECT repo, count(*) / sum(count(*)) OVER () AS s FROM (SELECT * FROM items ORDER BY instance LIMIT 100) GROUP BY repo",
    sampled="""SELECT repo, count(*) / sum(count(*)) OVER () AS s FROM (SELECT * FROM items
    ORDER BY md5(instance || '|42'), instance LIMIT 100) GROUP BY repo""") + """
SELECT coalesce(f.repo, s.repo) AS repo, round(coalesce(f.s, 0), 6) AS slice_share,
  round(coalesce(s.s, 0), 6) AS sample_share, round(coalesce(f.s, 0) - coalesce(s.s, 0), 6) AS bias
FROM first f FULL JOIN sampled s ON f.repo = s.repo""")
def slice_bias(spark, sf_dir):
    items = verd_attempts(spark, sf_dir).select("instance", "repo").distinct()
    out = sampling.slice_bias(items, "instance", "repo", 100, 42)
    return rounded(out, slice_share=6, sample_share=6, bias=6)


@register("verdict_scores", views("verd") + """
SELECT system, repo, count(*) AS n, count(*) FILTER (WHERE resolved) AS n_correct,
  round(avg(CAST(resolved AS INT)), 6) AS score,
  CASE WHEN count(*) > 1 THEN round(sqrt(avg(CAST(resolved AS INT)) * (1 - avg(CAST(resolved AS INT))) / (count(*) - 1)), 6) END AS stderr
FROM verd GROUP BY system, repo""")
def verdict_scores(spark, sf_dir):
    out = scoring.score_summary(verd(spark, sf_dir), ["system", "repo"], "resolved")
    return rounded(out, score=6, stderr=6)
