"""Readers on small hand-written artefacts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallywright.operators import throughput, trust, verdicts
from tallywright.sources import agentic, reports, results, sweeps


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).orderBy(*columns).collect()]


def test_eval_results_of_both_generations(spark, fixtures):
    m = results.read_eval_results(spark, f"{fixtures}/f1").cache()
    assert m.count() == 8
    assert m.where("is_stderr AND value IS NULL").count() == 1
    got = {(r.task, r.metric, r.filter): r for r in m.where("NOT is_stderr").collect()}
    old, new = got["sums", "exact_match", "strict-match"], got["sums", "exact_match", "answer-line"]
    assert (old.value, old.n, old.harness_version, old.max_gen_toks) == (0.25, 20, "1.0", 512)
    assert old.model_args["base_url"] == "http://h:1/v1?key=x"
    assert old.run_ts == dt.datetime(2023, 11, 14, 22, 13, 20, 500000)
    assert (new.max_gen_toks, new.eval_seconds, new.model_args["num_concurrent"]) == (1024, 30.5, "6")
    assert m.where("task = 'sums'").select("task_hash").distinct().count() == 2


def test_bench_levels_from_json_and_csv(spark, fixtures):
    j = sweeps.read_bench_json(spark, f"{fixtures}/f2/net-a/raw/bench_c*.json")
    assert rows(j, "model", "concurrency", "max_concurrent", "out_tok_s", "request_goodput") == [
        ("lab/net-a", 1, 2, 4.0, None), ("lab/net-a", 4, 7, 4.0, None)]
    c = sweeps.read_sweep_csv(spark, f"{fixtures}/f2/net-a/raw/throughput_sweep.csv")
    assert rows(c, "model", "concurrency", "out_tok_s", "median_ttft_ms") == [
        ("net-a", 1, 4.0, 9.0), ("net-a", 4, 10.0, None)]


def test_sweep_logs_of_all_dialects(spark, fixtures):
    levels = sweeps.read_sweep_log(spark, f"{fixtures}/f3").cache()
    assert levels.count() == 6 + 3 + 4
    a = levels.where("model = 'net-a'")
    assert rows(a, "concurrency", "out_tok_s")[:2] == [(1, 10.0), (2, 19.0)]
    assert rows(levels.where("model = 'net-b'"), "concurrency", "num_prompts",
                "engine_running_before", "level_ts") == [
        (1, 16, 0.0, "12:01:33"), (2, 16, 0.0, "12:02:33"), (4, 16, 3.0, "12:04:33")]
    assert rows(levels.where("model = 'net-c'"), "concurrency", "num_prompts", "completed") == [
        (c, 3, 8.0) for c in (1, 4, 8, 16)]
    flat = throughput.flag_flat_spot(levels.where("model = 'net-c'"), system="model")
    assert [r.concurrency for r in flat.where("flat_spot").collect()] == [8]
    warm = throughput.flag_warmup(a, system="model")
    assert [r.concurrency for r in warm.where("warmup").collect()] == [8]
    plateau = throughput.find_plateau(a, system="model").first()
    assert (plateau.plateau_level, plateau.state) == (32, "plateau")
    idle = throughput.idle_before_level(levels, "engine_running_before")
    assert {r.start_state for r in idle.where("model = 'net-b'").collect()} == {"idle", "busy"}


def test_grader_reports(spark, fixtures):
    items = agentic.read_swe_report(spark, f"{fixtures}/f4")
    assert items.count() == 10 + 6
    counts = agentic.read_swe_counts(spark, f"{fixtures}/f4")
    checked = trust.conservation_checks(counts)
    assert rows(checked, "run", "conserved") == [("run1_report", True), ("run2_report", False)]
    again = trust.report_counts(items, ["run"])
    first = again.where("run = 'run1_report'").first()
    assert (first.total, first.submitted, first.completed, first.incomplete) == (10, 6, 5, 4)


def test_exit_statuses_with_repeated_root(spark, fixtures):
    e = agentic.read_exit_status(spark, f"{fixtures}/f5").cache()
    assert rows(e.where("run = 'exit_statuses_all'"), "segment", "status", "instance_id") == [
        (1, "Submitted", "lab__tool-1"), (1, "Timeout", "lab__kit-3"), (1, "Timeout", "lab__tool-2"),
        (2, "LimitsExceeded", "lab__kit-3"), (2, "Submitted", "lab__tool-2")]
    last = verdicts.last_status_wins(e, ["run", "instance_id"], ["segment"], ["status"])
    assert ("lab__tool-2", "Submitted", 2) in rows(last, "instance_id", "status", "n_attempts")


def test_agent_log(spark, fixtures):
    log = agentic.read_agent_log(spark, f"{fixtures}/f6").cache()
    assert {r.model for r in log.collect()} == {"lab/net-a"}
    outcome = log.where("event IN ('pass', 'fail')")
    assert rows(outcome, "problem", "event", "round", "candidate", "score", "unit") == [
        (1, "pass", None, None, None, None), (3, "pass", 2, None, None, None),
        (5, "pass", None, None, 71.4179, "GFLOP/s"), (8, "fail", None, None, None, None),
        (9, "pass", None, 4, 10.468, None), (30, "pass", None, 2, 2.6425, None)]
    assert rows(log.where("event = 'round'"), "round", "score", "unit") == [
        (1, 10.5, "GFLOP/s"), (2, 71.4179, "GFLOP/s")]
    assert rows(log.where("problem = 30 AND event = 'candidate'"), "candidate", "verdict", "score") == [
        (1, None, 1.0249), (2, "FIXED", 2.6425), (3, "CLEAN", 2.5)]
    assert rows(log.where("event = 'title' AND problem = 1"), "title") == [("stats tool",)]
    assert log.where("event = 'note'").count() == 1


def test_champions_agree_with_the_log(spark, fixtures):
    from tallywright.operators.attempts import pick_champion

    log = agentic.read_agent_log(spark, f"{fixtures}/f6")
    best = pick_champion(log.where("event = 'candidate'"), ["problem"], "candidate", "score")
    stated = log.where("is_champion").select("problem", F.col("candidate").alias("stated"))
    assert best.join(stated, "problem").where("champion <> stated").count() == 0


def test_progress_frames(spark, fixtures):
    p = agentic.read_progress_log(spark, f"{fixtures}/f7")
    assert rows(p, "seq", "done", "ok", "bad", "error", "elapsed_s") == [
        (1, 0, 0, 0, 0, 0), (2, 1, 0, 1, 0, 34), (3, 3, 1, 1, 1, 62), (4, 4, 2, 1, 1, 3605)]


def test_claims(spark, fixtures):
    c = reports.read_claims(spark, f"{fixtures}/f8").cache()
    got = {(r.model, r.metric): r for r in c.collect()}
    assert len(got) == 9
    peak = got["lab/net-a", "Peak tok/s"]
    assert (peak.value, peak.qualifier, peak.line) == (1709.0, "~ c=128, capped", 5)
    assert (got["lab/net-a", "GSM"].value, got["lab/net-a", "GSM"].unit) == (97.19, "%")
    assert (got["lab/net-a", "Runs"].value, got["lab/net-a", "Runs"].denominator) == (29.0, 30.0)
    assert got["lab/net-a", "Note"].value == 66.9
    states = [got["lab/net-b", m].state for m in ("GSM", "Peak tok/s", "Runs", "Note")]
    assert states == ["not_measured", "blocked", "excluded", "measured"]
    assert got["16k", "Acc"].value == 53.03


def test_replay_and_diagnosis(spark, fixtures):
    r = results.read_replay(spark, f"{fixtures}/f9")
    assert rows(r, "run", "doc_id", "finish_reason", "completion_tokens", "correct") == [
        ("replay_results", 1, "stop", 100, True), ("replay_results", 2, "length", 300, False),
        ("replay_results", 3, "ERROR", None, False)]
    assert rows(results.read_diagnosis(spark, f"{fixtures}/f10"), "run", "status", "n") == [
        ("shuffle", "RepeatedFormatError", 7), ("shuffle", "Submitted", 2)]
    e = results.read_diagnosis_examples(spark, f"{fixtures}/f10").first()
    assert (e.instance_id, e.successful_execs, e.error_offset) == ("lab__tool-1", 5, 1610)
    assert e.error == "Expecting ',' delimiter"


def test_catalogue_and_provenance(spark, fixtures):
    cat = reports.catalog_runs(spark, fixtures).cache()
    kinds = {r.kind: r["count"] for r in cat.groupBy("kind").count().collect()}
    assert kinds == {"eval_results": 2, "bench_level": 2, "sweep_csv": 1, "sweep_log": 4,
                     "grader_report": 2, "exit_status": 2, "agent_log": 1, "progress_log": 1,
                     "report": 1, "replay": 1, "diagnosis": 1}
    names = cat.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"))
    claimed = spark.createDataFrame([("DIAGNOSIS.json",), ("preds.json",)], "path string")
    assert rows(trust.provenance_check(claimed, names), "path") == [("preds.json",)]


def test_runs_of_one_task_are_not_comparable(spark, fixtures):
    from tallywright.operators.comparison import comparability_check, run_configs

    m = results.read_eval_results(spark, f"{fixtures}/f1").withColumn(
        "run", F.regexp_extract("file", "([a-z]+)[.]json$", 1))
    configs = run_configs(m, "run").where("task = 'sums'")
    diff = comparability_check(configs, "old", system="run")
    got = {r.key: (r.value, r.reference) for r in diff.collect()}
    assert got["task_hash"] == ("ccc", "aaa")
    assert got["max_gen_toks"] == ("1024", "512")
    assert got["filters"] == ("answer-line", "flexible,strict-match")
    assert "args.model" not in got and got["args.num_concurrent"] == ("6", "4")


def test_generation_settings_decide_comparability(spark, tmp_path):
    from tallywright.operators.comparison import comparability_check, run_configs

    def result(settings, shots, asked="null"):
        return ('{"results": {"gsm": {"em,strict": 0.5}}, "configs": {"gsm": {"generation_kwargs": ' + settings + ', "num_fewshot": '
                + shots + '}}, "config": {"gen_kwargs": ' + asked + '}, "model_name": "m", "task_hashes": {"gsm": "h"}}')

    folder = tmp_path / "m" / "raw"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text(result('{"until": ["Q:", "</s>"], "temperature": 0, "max_gen_toks": 512}', "0"))
    (folder / "b.json").write_text(result('{"until": ["Q:"], "temperature": 0, "max_gen_toks": 512}', "5"))
    (folder / "c.json").write_text(result('{"until": ["Q:", "</s>"], "temperature": 0, "max_gen_toks": 512}', "0", '{"temperature": 0.6}'))
    m = results.read_eval_results(spark, str(tmp_path)).withColumn("run", F.regexp_extract("file", "([a-z])[.]json$", 1))
    diff = comparability_check(run_configs(m, "run"), "a", system="run").collect()
    assert sorted(tuple(r) for r in diff) == [
        ("b", "num_fewshot", "5", "0"), ("b", "until", '["Q:"]', '["Q:","</s>"]'), ("c", "temperature", "0.6", "0"),
    ]


def test_claims_are_reconciled_with_measured_scores(spark, fixtures):
    from tallywright.functions import parsing
    from tallywright.operators.comparison import reconcile
    from tallywright.operators.scoring import headline_scores

    m = results.read_eval_results(spark, f"{fixtures}/f1").withColumn(
        "task", F.when(F.col("task") == "sums", "GSM").otherwise(F.col("task")))
    measured = headline_scores(m, {"GSM": ("exact_match", "answer-line")}).select(
        "model", F.col("task").alias("metric"), "value")
    claims = reports.read_claims(spark, f"{fixtures}/f8").select(
        "model", "metric", parsing.as_share(parsing.parse_measure(F.col("raw"))).alias("value"))
    out = reconcile(claims, measured, ["model", "metric"], "value", 0.005)
    status = {(r.model, r.metric): r.status for r in out.collect()}
    assert status["lab/net-a", "GSM"] == "differs"
    assert status["lab/net-a", "Runs"] == "not measured"
    assert status["lab/net-b", "GSM"] == "not claimed"


def test_logs_read_in_many_splits_keep_their_order(spark, fixtures):
    """Files cut every 200 bytes over several tasks give the same rows."""
    def read():
        return [
            rows(agentic.read_exit_status(spark, f"{fixtures}/f5"), "run", "segment", "status", "instance_id"),
            rows(sweeps.read_sweep_log(spark, f"{fixtures}/f3").drop("file"), "model", "concurrency",
                 "num_prompts", "out_tok_s", "mean_tpot_ms", "engine_running_before"),
            rows(agentic.read_agent_log(spark, f"{fixtures}/f6"), "problem", "event", "candidate", "score", "model"),
            rows(agentic.read_progress_log(spark, f"{fixtures}/f7"), "seq", "done", "ok", "elapsed_s"),
        ]

    whole = read()
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "200b")
    try:
        assert spark.read.text(f"{fixtures}/f3/net-c/raw").rdd.getNumPartitions() > 4
        assert read() == whole
    finally:
        spark.conf.set(setting, before)


def test_agent_log_is_read_in_tasks_by_rows(spark, tmp_path, monkeypatch):
    from tallywright.operators import running as module

    monkeypatch.setattr(module, "TASK_ROWS", 20)
    for k in range(60):
        lines = ["==== tag (org/m) START Sat Aug  1 2026 ====", "note", f"P{k}: PASS in 3", f"P{k}: round 2 -> 5.5 GB/s", f"P{k}: cand_7 verdict=ok score=2"]
        (tmp_path / f"log{k}.txt").write_text("\n".join(lines))
    log = agentic.read_agent_log(spark, str(tmp_path))
    assert log.rdd.getNumPartitions() >= 15
    got = rows(log.where("problem = 9"), "event", "round", "candidate", "score", "unit", "verdict", "model")
    assert got == [
        ("candidate", None, 7, 2.0, None, "OK", "org/m"), ("pass", 3, None, None, None, None, "org/m"),
        ("round", 2, None, 5.5, "GB/s", None, "org/m"),
    ]
    assert log.count() == 180
