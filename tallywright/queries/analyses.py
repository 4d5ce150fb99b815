"""The end-to-end analyses on the shared tables."""

from __future__ import annotations

from tallywright.plans import agentic, quality, sweep
from tallywright.queries.agentic import STATUS_CLASS
from tallywright.queries.bindings import lvl, resp, verd_attempts, views
from tallywright.queries.registry import register, rounded


@register("quality_card", views("scored") + """
SELECT system, task, count(*) AS n, round(avg(CAST(ok_line AS INT)), 6) AS score,
  round(stddev_samp(CAST(ok_line AS INT)) / sqrt(count(*)), 6) AS stderr,
  round(avg(CASE WHEN content IS NULL THEN 1 ELSE 0 END), 6) AS null_rate,
  round(avg(CASE WHEN pred_line IS NOT DISTINCT FROM pred_fallback THEN 1 ELSE 0 END), 6) AS agreement,
  round(avg(CAST(ok_line AS INT)) - avg(CAST(ok_fallback AS INT)), 6) AS score_gap,
  abs(avg(CAST(ok_line AS INT)) - avg(CAST(ok_fallback AS INT))) <= 0.05
    AND avg(CASE WHEN content IS NULL THEN 1 ELSE 0 END) <= 0.1 AS trusted
FROM scored GROUP BY system, task""")
def quality_card(spark, sf_dir):
    return rounded(quality.quality_card(resp(spark, sf_dir)), score=6, stderr=6, null_rate=6,
                   agreement=6, score_gap=6)


@register("sweep_summary", views("gains", m="""SELECT *, max(gain) OVER (PARTITION BY system
    ORDER BY concurrency ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
    lead(gain) OVER (PARTITION BY system ORDER BY concurrency) AS nxt,
    lead(ttft_ms) OVER (PARTITION BY system ORDER BY concurrency) AS nt FROM gains""",
    f="""SELECT system, arg_min(out_tok_s, concurrency) AS single_stream, count(*) AS n_levels,
    min(concurrency) FILTER (WHERE gain IS NOT NULL AND rest < 0.02) AS plateau_level,
    min(concurrency) FILTER (WHERE nxt < 0.02 AND nt >= 1.0 * ttft_ms) AS stop,
    arg_max(concurrency, (out_tok_s, -concurrency)) AS top, max(out_tok_s) AS peak,
    max(concurrency) FILTER (WHERE tpot_ms < 102) AS operating_level,
    arg_max(out_tok_s, concurrency) FILTER (WHERE tpot_ms < 102) AS rate_at_slo,
    arg_max(tpot_ms, concurrency) FILTER (WHERE tpot_ms < 102) AS tpot_at_slo FROM m GROUP BY system""") + """
SELECT f.system, single_stream, n_levels, plateau_level,
  CASE WHEN plateau_level IS NULL THEN 'still climbing' ELSE 'plateau' END AS state,
  peak AS sustained_peak, top AS sustained_level, coalesce(l.out_tok_s, peak) AS practical_peak,
  coalesce(stop, top) AS practical_level,
  CASE WHEN stop IS NULL THEN 'same' ELSE 'practical below sustained' END AS claim,
  operating_level, rate_at_slo, tpot_at_slo
FROM f LEFT JOIN lvl l ON l.system = f.system AND l.concurrency = f.stop""")
def sweep_summary(spark, sf_dir):
    return sweep.sweep_summary(lvl(spark, sf_dir), threshold=0.02, slo=102.0, cost=1.0)


@register("verdict_card", views("verd") + """
SELECT system, count(*) AS n, count(*) FILTER (WHERE resolved) AS resolved,
  CAST(sum(n_attempts) AS BIGINT) AS n_attempts, count(*) FILTER (WHERE status = 'P') AS infra_failures,
  round(avg(CAST(resolved AS INT)), 6) AS rate,
  round(sqrt(avg(CAST(resolved AS INT)) * (1 - avg(CAST(resolved AS INT))) / count(*)), 6) AS margin
FROM verd GROUP BY system""")
def verdict_card(spark, sf_dir):
    out = agentic.verdict_card(
        verd_attempts(spark, sf_dir), ["attempted_at", "attempt"], "F", STATUS_CLASS
    )
    return rounded(out, rate=6, margin=6)
