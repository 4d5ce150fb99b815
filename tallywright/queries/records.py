"""Reader and sink queries.

Spark first writes artefacts derived from the shared tables into the shared
work folder, then the readers read them back. Artefacts that list many items
are cut into files of bounded size, so no group is gathered without limit.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywright import schemas
from tallywright.operators import scoring, trust
from tallywright.queries.agentic import _INSTANCES, _instances
from tallywright.queries.bindings import (
    LANGS, cand, lvl, score_table, scored, verd_attempts, views,
)
from tallywright.queries.registry import register, rounded
from tallywright.sources import agentic, reports, results, sweeps
from tallywright.workspace import shared_dir

# Items per derived file.
BLOCK = 1000


def _write_lines(df, purpose, *partition_by):
    """Write column ``value`` as text files, one folder per partition value."""
    path = shared_dir(df.sparkSession, purpose)
    df.select(*partition_by, "value").write.partitionBy(*partition_by).text(path)
    return path


def _by_block(rows, *order):
    """Rows in ``order``, the lines of a block in one task: a file each, and tasks that no merging makes larger."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "block").sortWithinPartitions("block", *order)


@register("read_eval_results", views("scores") + """
SELECT system AS model, task, 'acc' AS metric, 'answer-line' AS filter, is_stderr,
  CASE WHEN NOT is_stderr THEN round(score, 6) WHEN n > 1 THEN round(sqrt(score * (1 - score) / (n - 1)), 6) END AS value,
  n, '7' AS concurrency, CAST(8192 AS BIGINT) AS max_gen_toks, task || '-hash' AS task_hash,
  CAST(12.5 AS DOUBLE) AS eval_seconds
FROM scores, (SELECT unnest([FALSE, TRUE]) AS is_stderr)""")
def read_eval_results(spark, sf_dir):
    s = score_table(spark, sf_dir)
    per_task = s.select(
        "system", "task",
        F.create_map(
            F.lit("alias"), F.col("task"),
            F.lit("acc,answer-line"), F.col("score").cast("string"),
            F.lit("acc_stderr,answer-line"), F.coalesce(F.col("stderr").cast("string"), F.lit("N/A")),
        ).alias("entries"),
        F.struct(F.col("n").alias("original"), F.col("n").alias("effective")).alias("samples"),
        F.concat("task", F.lit("-hash")).alias("hash"),
    )
    # One entry per benchmark: a result file is as long as the benchmark list.
    files = per_task.groupBy("system").agg(
        *[
            F.map_from_entries(F.collect_list(F.struct("task", c))).alias(c)
            for c in ("entries", "samples", "hash")
        ]
    )
    even = F.pmod(F.hash("system"), F.lit(2)) == 0
    as_object = F.lit('"model_args": {"num_concurrent": 7}')
    as_text = F.lit('"model_args": "num_concurrent=7,base_url=http://h/?a=b"')
    value = F.concat(
        F.lit('{"results": '), F.to_json("entries"), F.lit(', "n-samples": '), F.to_json("samples"),
        F.lit(', "task_hashes": '), F.to_json("hash"), F.lit(', "config": {'),
        F.when(even, as_object).otherwise(as_text),
        F.lit(', "gen_kwargs": {"max_gen_toks": 8192}}, "date": 1785193803.66, "model_name": "'),
        F.col("system"), F.lit('", "total_evaluation_time_seconds": "12.5"}'),
    )
    path = _write_lines(files.select("system", value.alias("value")), "eval", "system")
    out = results.read_eval_results(spark, path)
    return rounded(
        out.select(
            "model", "task", "metric", "filter", "is_stderr", "value", "n",
            F.try_element_at("model_args", F.lit("num_concurrent")).alias("concurrency"),
            "max_gen_toks", "task_hash", "eval_seconds",
        ),
        value=6,
    )


_LEVEL_COLUMNS = "system AS model, concurrency, num_prompts, out_tok_s, ttft_ms AS mean_ttft_ms, p99_ttft_ms, tpot_ms AS mean_tpot_ms"


def _level_view(df):
    return df.select(
        "model", "concurrency", F.col("num_prompts").cast("bigint").alias("num_prompts"),
        "out_tok_s", "mean_ttft_ms", "p99_ttft_ms", "mean_tpot_ms",
    )


@register("read_bench_json", views("lvl") + f"SELECT {_LEVEL_COLUMNS} FROM lvl")
def read_bench_json(spark, sf_dir):
    rows = lvl(spark, sf_dir).select(
        F.to_json(
            F.struct(
                F.col("system").alias("model_id"), F.col("concurrency").alias("max_concurrency"),
                "num_prompts", F.col("out_tok_s").alias("output_throughput"),
                F.lit(None).cast("double").alias("request_goodput"),
                F.col("ttft_ms").alias("mean_ttft_ms"), "p99_ttft_ms",
                F.col("tpot_ms").alias("mean_tpot_ms"),
            )
        ).alias("value"),
        F.col("system").alias("dir"),
    )
    return _level_view(sweeps.read_bench_json(spark, _write_lines(rows, "bench", "dir")))


@register("read_sweep_csv", views("lvl") + f"SELECT {_LEVEL_COLUMNS} FROM lvl")
def read_sweep_csv(spark, sf_dir):
    names = [c.split()[0] for c in schemas.SWEEP_CSV.split(", ")]
    have = {"concurrency": "concurrency", "num_prompts": "num_prompts", "out_tok_s": "out_tok_s",
            "mean_ttft_ms": "ttft_ms", "p99_ttft_ms": "p99_ttft_ms", "mean_tpot_ms": "tpot_ms"}
    path = shared_dir(spark, "csv")
    lvl(spark, sf_dir).select(
        F.col("system").alias("dir"),
        *[(F.col(have[n]) if n in have else F.lit(None).cast("double")).alias(n) for n in names],
    ).write.partitionBy("dir").option("header", "true").csv(path)
    return _level_view(sweeps.read_sweep_csv(spark, path))


@register("read_sweep_log", views("lvl") + f"""
SELECT {_LEVEL_COLUMNS}, CASE system WHEN 'N' THEN 0.0::DOUBLE END AS engine_running_before FROM lvl""")
def read_sweep_log(spark, sf_dir):
    c, n = F.col("concurrency").cast("string"), F.col("num_prompts").cast("string")
    header = (
        F.when(F.col("system") == "A", F.concat(F.lit("=== concurrency="), c, F.lit(" num_prompts="), n, F.lit(" ===")))
        .when(F.col("system") == "N", F.concat(
            F.lit("=== concurrency="), c, F.lit(" num_prompts="), n,
            F.lit(" (engine_running_before=0.0) 12:27:33 ===")))
        .otherwise(F.concat(
            F.lit("=================== CONCURRENCY "), c,
            F.lit(" ===================\nNamespace(seed=0, num_prompts="), n,
            F.lit(", x=1)\n  0%|  | 0/3\r100%|##| 3/3")))
    )
    lines = [
        F.concat(F.rpad(F.lit(label + ":"), F.lit(40), F.lit(" ")), F.col(col).cast("string"))
        for label, col in (
            ("Output token throughput (tok/s)", "out_tok_s"), ("Mean TTFT (ms)", "ttft_ms"),
            ("P99 TTFT (ms)", "p99_ttft_ms"), ("Mean TPOT (ms)", "tpot_ms"),
        )
    ]
    rows = lvl(spark, sf_dir).select(
        F.col("system").alias("dir"),
        F.concat(F.concat_ws("\n", header, *lines), F.lit("\n")).alias("value"),
    )
    out = sweeps.read_sweep_log(spark, _write_lines(rows, "sweep", "dir"))
    return out.select(
        "model", "concurrency", F.col("num_prompts").cast("bigint").alias("num_prompts"),
        "out_tok_s", "mean_ttft_ms", "p99_ttft_ms", "mean_tpot_ms", "engine_running_before",
    )


def _report_files(spark, sf_dir):
    """Grader reports of at most BLOCK items each."""
    rows = _instances(spark, sf_dir).withColumn("block", F.floor(F.col("instance") / BLOCK))
    ids = [
        F.collect_list(F.when(F.col("status") == s, F.col("instance").cast("string"))).alias(f"{s}_ids")
        for s in agentic.STATUSES
    ]
    n = {s: F.count_if(F.col("status") == s) for s in agentic.STATUSES}
    files = rows.groupBy("system", "block").agg(
        *ids,
        F.count(F.lit(1)).alias("total_instances"),
        (F.count(F.lit(1)) - n["incomplete"]).alias("submitted_instances"),
        (n["resolved"] + n["unresolved"]).alias("completed_instances"),
        *[n[s].alias(f"{s}_instances") for s in ("resolved", "unresolved", "empty_patch", "error")],
    )
    body = F.to_json(F.struct(*[c for c in files.columns if c not in ("system", "block")]))
    return _write_lines(files.select("system", "block", body.alias("value")), "grader", "block", "system")


@register("read_swe_report", _INSTANCES +
          "SELECT system AS model, CAST(instance AS VARCHAR) AS instance_id, status FROM instances")
def read_swe_report(spark, sf_dir):
    out = agentic.read_swe_report(spark, _report_files(spark, sf_dir))
    return out.select(F.replace("model", F.lit("%20"), F.lit(" ")).alias("model"), "instance_id", "status")


@register("read_swe_counts", _INSTANCES + """
SELECT system AS model, count(*) AS total, count(*) FILTER (WHERE status <> 'incomplete') AS submitted,
  count(*) FILTER (WHERE status IN ('resolved', 'unresolved')) AS completed,
  TRUE AS conserved FROM instances GROUP BY system""")
def read_swe_counts(spark, sf_dir):
    counts = trust.conservation_checks(
        agentic.read_swe_counts(spark, _report_files(spark, sf_dir))
    )
    return counts.groupBy(F.replace("model", F.lit("%20"), F.lit(" ")).alias("model")).agg(
        F.sum("total").alias("total"), F.sum("submitted").alias("submitted"),
        F.sum("completed").alias("completed"), F.bool_and("conserved").alias("conserved"),
    )


@register("read_exit_status", views("attempts") + """
SELECT block, CAST(row_number() OVER (PARTITION BY block ORDER BY attempt) AS INT) AS segment,
  'S' || status AS status, 'org__repo-' || instance AS instance_id
FROM (SELECT *, CAST(attempt // 1000 AS INT) AS block FROM attempts)""")
def read_exit_status(spark, sf_dir):
    rows = verd_attempts(spark, sf_dir).select(
        F.floor(F.col("attempt") / BLOCK).alias("block"),
        "attempt",
        F.concat(
            F.lit("# resumed\ninstances_by_exit_status:\n    S"), F.col("status"),
            F.lit(":\n    - org__repo-"), F.col("instance").cast("string"),
        ).alias("value"),
    )
    ordered = _by_block(rows, "attempt")
    out = agentic.read_exit_status(spark, _write_lines(ordered, "exits", "block"))
    return out.select(
        F.regexp_extract("file", "block=([0-9]+)", 1).cast("int").alias("block"),
        "segment", "status", "instance_id",
    )


@register("read_agent_log", views("cand") + """
SELECT 'org/m' AS model, CAST(problem AS INT) AS problem, 'candidate' AS event, candidate, score, 'CLEAN' AS verdict FROM cand""")
def read_agent_log(spark, sf_dir):
    rows = cand(spark, sf_dir).select(
        F.floor(F.col("problem") / BLOCK).alias("block"),
        F.concat(
            F.lit("P"), F.col("problem").cast("string"), F.lit(": cand_"), F.col("candidate").cast("string"),
            F.lit(" verdict=VERDICT: CLEAN score="), F.col("score").cast("decimal(20,2)").cast("string"),
        ).alias("value"),
    )
    start = rows.select("block").distinct().select(
        "block", F.lit("==== tag (org/m) START Sat Aug  1 2026 ====").alias("value")
    )
    ordered = _by_block(start.withColumn("o", F.lit(0)).unionByName(rows.withColumn("o", F.lit(1))), "o")
    out = agentic.read_agent_log(spark, _write_lines(ordered, "agent", "block"))
    return out.select("model", "problem", "event", "candidate", "score", "verdict")


def _progress_lines(spark, sf_dir):
    """One progress frame per attempt, in files of BLOCK attempts."""
    a = F.col("attempt")
    done = (a % BLOCK).cast("string")
    return verd_attempts(spark, sf_dir).select(
        F.floor(a / BLOCK).alias("block"),
        "attempt",
        F.concat(
            F.lit("Evaluation:  1%|█ | "), done, F.lit(f"/{BLOCK} [01:"),
            F.lpad((a % 60).cast("string"), 2, "0"), F.lit("<50:38, 34.5s/it, ✓="),
            F.when(F.col("status") == "F", 1).otherwise(0).cast("string"), F.lit(", ✖="),
            F.when(F.col("status") == "O", 1).otherwise(0).cast("string"), F.lit(", error="),
            F.when(F.col("status") == "P", 1).otherwise(0).cast("string"), F.lit("]"),
        ).alias("value"),
    )


@register("read_progress_log", views("attempts") + """
SELECT CAST(attempt // 1000 AS INT) AS block, row_number() OVER (PARTITION BY attempt // 1000 ORDER BY attempt) AS seq,
  CAST(attempt % 1000 AS INT) AS done, 1000 AS total, CAST(status = 'F' AS INT) AS ok,
  CAST(status = 'O' AS INT) AS bad, CAST(status = 'P' AS INT) AS error,
  CAST(60 + attempt % 60 AS INT) AS elapsed_s FROM attempts""")
def read_progress_log(spark, sf_dir):
    ordered = _by_block(_progress_lines(spark, sf_dir), "attempt")
    out = agentic.read_progress_log(spark, _write_lines(ordered, "progress", "block"))
    return out.select(
        F.regexp_extract("file", "block=([0-9]+)", 1).cast("int").alias("block"),
        "seq", "done", "total", "ok", "bad", "error", "elapsed_s",
    )


def _board(spark, sf_dir):
    return scoring.leaderboard(score_table(spark, sf_dir), LANGS)


_CELLS = views("scores", cells="""SELECT m.system, t.task, s.score FROM (SELECT DISTINCT system FROM scores) m,
  (SELECT unnest(['de', 'en', 'es', 'fr']) AS task) t
  LEFT JOIN scores s ON s.system = m.system AND s.task = t.task""")


@register("render_report", _CELLS + """
SELECT 2 AS pos, '| ' || system || ' | ' || string_agg(
  CASE WHEN score IS NULL THEN '—' ELSE CAST(CAST(round(score * 100, 2) AS DECIMAL(10,2)) AS VARCHAR) || '%' END,
  ' | ' ORDER BY task) || ' |' AS line FROM cells GROUP BY system
UNION ALL SELECT 0, '| system | de | en | es | fr |' UNION ALL SELECT 1, '| --- | --- | --- | --- | --- |'""")
def render_report(spark, sf_dir):
    return reports.render_report(_board(spark, sf_dir), "system", LANGS)


@register("read_claims", _CELLS + """
SELECT system AS model, task AS metric, CASE WHEN score IS NULL THEN NULL ELSE round(score * 100, 2) END AS value,
  CASE WHEN score IS NOT NULL THEN '%' END AS unit,
  CASE WHEN score IS NULL THEN 'not_measured' ELSE 'measured' END AS state FROM cells""")
def read_claims(spark, sf_dir):
    path = shared_dir(spark, "report")
    reports.write_report(_board(spark, sf_dir), "system", LANGS, path)
    return reports.read_claims(spark, path).select("model", "metric", "value", "unit", "state")


@register("read_replay", views("scored") + """
SELECT doc_id, finish_reason, n_chars AS completion_tokens, pred_line AS pred, gold, ok_line AS correct FROM scored""")
def read_replay(spark, sf_dir):
    rows = scored(spark, sf_dir).select(
        F.floor(F.col("doc_id") / BLOCK).alias("block"),
        F.struct(
            F.col("doc_id").alias("doc"), F.col("finish_reason").alias("fr"),
            F.col("n_chars").alias("ct"), F.col("pred_line").alias("pred"), "gold",
            F.col("ok_line").alias("correct"),
        ).alias("row"),
    )
    files = rows.groupBy("block").agg(F.to_json(F.collect_list("row")).alias("value"))
    out = results.read_replay(spark, _write_lines(files, "replay", "block"))
    return out.drop("run")


@register("read_diagnosis", views("attempts") + """
SELECT system AS run, status, count(*) AS n FROM attempts GROUP BY ALL""")
def read_diagnosis(spark, sf_dir):
    counts = verd_attempts(spark, sf_dir).groupBy("system", "status").agg(F.count(F.lit(1)).alias("n"))
    files = counts.groupBy("system").agg(
        F.to_json(
            F.struct(
                F.first("system").alias("run"),
                F.map_from_entries(F.collect_list(F.struct("status", "n"))).alias("counts"),
                F.array(
                    F.struct(
                        F.lit("a__b-1").alias("instance"), F.lit(5).alias("successful_command_execs"),
                        F.lit("Error parsing tool call arguments: x: line 1 column 2 (char 1).").alias("sample_error"),
                    )
                ).alias("examples"),
            )
        ).alias("value")
    )
    return results.read_diagnosis(spark, _write_lines(files, "diagnosis", "system"))


@register("catalog_runs", views("lvl") + """
SELECT system AS model, 'bench_level' AS kind, count(*) AS files FROM lvl GROUP BY system
UNION ALL SELECT system, 'sweep_log', 1 FROM lvl GROUP BY system""")
def catalog_runs(spark, sf_dir):
    return _catalogued(spark, sf_dir).groupBy("model", "kind").agg(
        F.countDistinct("name").alias("files")
    )


def _catalogued(spark, sf_dir):
    """Catalogue of a derived tree with a folder per model and file."""
    root = shared_dir(spark, "tree")
    levels = lvl(spark, sf_dir).select(
        F.col("system").alias("model"), "concurrency", F.to_json(F.struct("out_tok_s")).alias("value")
    )
    # Folder names stand for file names: the text sink names its own part files.
    levels.withColumn("file", F.lit("bench_c.json")).write.partitionBy(
        "model", "file", "concurrency"
    ).text(root)
    levels.select("model", F.lit("sweep.log").alias("file"), "value").write.mode("append").partitionBy(
        "model", "file"
    ).text(root)
    name = F.regexp_extract("path", r"/file=(.*)/[^/]+$", 1)
    kind = F.when(name.startswith("bench"), "bench_level").otherwise("sweep_log")
    return reports.catalog_runs(spark, root).select("model", name.alias("name"), kind.alias("kind"))


@register("provenance_check", views("lvl") + """
SELECT DISTINCT system AS model, 'bench_c.json/concurrency=99' AS path FROM lvl""")
def provenance_check(spark, sf_dir):
    have = _catalogued(spark, sf_dir).select(F.concat_ws("/", "model", "name").alias("path"))
    levels = lvl(spark, sf_dir).select(
        "system", F.explode(F.array("concurrency", F.lit(99))).alias("c")
    ).distinct()
    claimed = levels.select(
        "system", F.concat(F.col("system"), F.lit("/bench_c.json/concurrency="), F.col("c").cast("string")).alias("path")
    )
    return trust.provenance_check(claimed, have).select(
        F.col("system").alias("model"), F.regexp_replace("path", "^[^/]*/", "").alias("path")
    )


@register("write_gold", views("scores") + """
SELECT system AS model, task, n, round(score, 6) AS score FROM scores""")
def write_gold(spark, sf_dir):
    path = shared_dir(spark, "gold")
    gold = score_table(spark, sf_dir).select(F.col("system").alias("model"), "task", "n", "score")
    reports.write_gold(gold, path)
    return rounded(spark.read.parquet(path).select("model", "task", "n", "score"), score=6)
