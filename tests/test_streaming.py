"""Streams fed in several batches, with late rows, against their table twins."""

from __future__ import annotations

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from tallywright.sources.agentic import parse_progress
from tallywright.streaming import health, metrics, verdicts
from tallywright.streaming.run import all_rows, drain, latest_rows

T0 = dt.datetime(2030, 1, 1)
SAMPLES = "ts timestamp, host string, metric string, value double"


def feed(spark, schema, *batches):
    """One file per batch, in order; the stream reads one file per micro-batch."""
    import time

    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part={i}")
        time.sleep(1.1)  # the file source orders files by their second
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true").parquet(folder)
    )


def at(minutes, **rest):
    return T0 + dt.timedelta(minutes=minutes, **rest)


def sample(minutes, value, host="h", metric="tokens"):
    return (at(minutes), host, metric, float(value))


def test_counter_rate_with_reset_and_late_row(spark):
    first = [sample(0, 100), sample(10, 400), sample(65, 700)]
    late = [sample(20, 600), sample(70, 50), sample(80, 90)]
    stream = metrics.counter_rate(feed(spark, SAMPLES, first, late), ["host"])
    got = latest_rows(spark, drain(stream, "update"), ["host", "window_start"])
    table = metrics.counter_rate(spark.createDataFrame(first + late, SAMPLES), ["host"])
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in table.collect()}
    assert [r.growth for r in table.orderBy("window_start").collect()] == [500.0, 90.0]


def test_idle_gate_over_batches(spark):
    a = [sample(5, 0, metric="running"), sample(70, 2, metric="running")]
    b = [sample(130, 0, metric="running"), sample(190, 0, metric="running")]
    busy = F.col("value")
    out = latest_rows(spark, drain(metrics.idle_gate(feed(spark, SAMPLES, a, b), ["host"], busy), "update"),
                      ["host", "window_start"])
    got = {r.window_start: r.idle for r in out.collect()}
    assert got == {at(-60): True, at(0): False, at(60): False, at(120): True, at(180): True}


PROBES = "ts timestamp, host string, endpoint string, ok boolean"


def test_wedge_is_found_in_stream_and_table(spark):
    rows = [(at(m), "h", "models", True) for m in range(0, 120, 7)]
    rows += [(at(m), "h", "chat", not 30 <= m < 90) for m in range(0, 120, 5)]
    rows += [(at(m), "g", "chat", m % 2 == 0) for m in range(0, 120, 5)]
    meta = (F.col("endpoint") == "models") & F.col("ok")
    good = (F.col("endpoint") == "chat") & F.col("ok")
    fail = (F.col("endpoint") == "chat") & ~F.col("ok")
    order = sorted(rows, key=lambda r: (r[0].minute % 7, r[2]))  # batches overlap in time
    found = [
        health.wedge_detector(feed(spark, PROBES, order[::3], order[1::3], order[2::3]), "host", "ts", meta, good, fail),
        health.wedge_detector(spark.createDataFrame(rows, PROBES), "host", "ts", meta, good, fail),
    ]
    for stretches in found:
        got = [(r.host, r.after, r.until, r.first_failure, r.last_failure, r.failures) for r in stretches.collect()]
        assert got == [("h", at(25), at(90), at(30), at(85), 12)]
    exact = health.wedge_stretches(
        spark.createDataFrame(rows, PROBES).withColumn("n", F.monotonically_increasing_id()),
        "host", "ts", ["ts", "n"], F.floor(F.unix_micros("ts") / 6e8), meta, good, fail,
    ).collect()
    assert [(r.host, r.wedged_from, r.wedged_to, r.failures) for r in exact] == [("h", at(30), at(85), 12)]


def test_wedge_lasts_from_success_to_success(spark):
    meta = (F.col("endpoint") == "models") & F.col("ok")
    good = (F.col("endpoint") == "chat") & F.col("ok")
    fail = (F.col("endpoint") == "chat") & ~F.coalesce("ok", F.lit(False))  # no answer is no success
    up = [(at(m), h, "models", True) for m in range(0, 200, 3) for h in "abcd"]
    rows = [(at(m), "a", "chat", m in (1, 59)) for m in (1, *range(3, 58, 6), 59)]  # across windows of half an hour
    rows += [(at(1), "b", "chat", True), (at(10), "b", "chat", None), (at(140), "b", "chat", None)]  # hangs to the end
    rows += [(at(m), "c", "chat", m % 20 == 0) for m in range(0, 200, 4)]  # fails often, not for long
    rows += [(at(0), "d", "chat", True), (at(120), "d", "chat", True)]  # nothing asked
    rows += [(at(m), "e", "chat", False) for m in range(0, 100, 5)]  # its metadata endpoint is down too
    got = health.wedge_detector(spark.createDataFrame(up + rows, PROBES), "host", "ts", meta, good, fail).collect()
    assert sorted((r.host, r.after, r.until, r.last_failure) for r in got) == [
        ("a", at(1), at(59), at(57)), ("b", at(1), None, at(140)),
    ]


def test_progress_frames_keep_the_latest(spark, fixtures):
    run = F.regexp_extract("file", r"/([^/]+)\.log$", 1)
    stream = verdicts.progress_stream(verdicts.progress_source(spark, f"{fixtures}/f7"), run)
    last = latest_rows(spark, drain(stream, "update"), ["run"]).first()
    assert (last.done, last.total, last.ok, last.bad, last.error, last.elapsed_s) == (4, 4, 2, 1, 1, 3605)


def test_duplicate_results_are_dropped_across_batches(spark):
    schema = "model string, task string, ts timestamp"
    a = [("m", "t", at(0)), ("m", "u", at(1))]
    b = [("m", "t", at(0)), ("n", "t", at(2))]
    fresh = verdicts.ingest_results(feed(spark, schema, a, b), ["model", "task"], "ts")
    got = all_rows(spark, drain(fresh, "append"))
    assert sorted((r.model, r.task) for r in got.collect()) == [("m", "t"), ("m", "u"), ("n", "t")]


def test_archive_takes_each_key_once(spark):
    schema = "model string, task string, ts timestamp, score double"
    a = [("m", "t", at(5), 1.0), ("m", "t", at(3), 2.0), (None, "t", at(1), 3.0)]
    b = [("m", "t", at(0), 4.0), (None, "t", at(0), 5.0), ("n", None, at(2), 6.0)]
    c = [("n", None, at(1), 7.0), ("n", "t", None, None), ("m", "t", at(9), 8.0)]
    got = verdicts.ingest_archive(feed(spark, schema, a, b, c), ["model", "task"], ["ts"])
    assert got.columns == ["model", "task", "ts", "score"]
    assert sorted(map(str, got.select("model", "task", "score").collect())) == sorted(
        f"Row(model={m!r}, task={t!r}, score={x})" for m, t, x in
        [("m", "t", 2.0), (None, "t", 3.0), ("n", None, 6.0), ("n", "t", None)]
    )


def test_runs_from_slots_of_batches_and_tables(spark):
    """Gaps are exact to the microsecond, across slots and batches, in any order, for a key with most rows."""
    import random

    rng, now, gap = random.Random(3), dt.datetime(2030, 1, 1, 0, 7, 13), dt.timedelta(minutes=30)
    rows, want = [], []
    for _ in range(12):
        start, n = now, rng.randrange(1, 60)
        for _ in range(n):
            rows.append((now, "hot"))
            last, now = now, now + rng.choice([dt.timedelta(0), dt.timedelta(minutes=7), gap - dt.timedelta(microseconds=1)])
        want.append(("hot", start, last + gap, n))
        now = last + gap + rng.choice([dt.timedelta(0), dt.timedelta(days=40)])
    rows += [(at(3), None), (at(20), None), (None, "hot"), (None, "none")]
    want.append((None, at(3), at(50), 2))
    rng.shuffle(rows)
    schema = "ts timestamp, host string"
    stream = feed(spark, schema, rows[::3], rows[1::3], rows[2::3])
    for activity in (stream, spark.createDataFrame(rows, schema)):
        got = metrics.archive_sessions(activity, ["host"], gap="30 minutes").select("host", "run_start", "run_end", "events")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    empty = metrics.archive_sessions(spark.createDataFrame([], schema), ["host"])
    assert empty.collect() == [] and empty.columns == ["host", "run_start", "run_end", "events"]


def test_late_segment_does_not_undo_a_newer_verdict(spark):
    schema = "i int, segment int, status string"
    newer, older = [(1, 2, "Submitted"), (2, 2, "Timeout")], [(1, 1, "Timeout"), (3, 1, "Submitted")]
    stream = feed(spark, schema, newer, older)
    got = verdicts.late_segments(stream, ["i"], ["segment"], ["status"]).collect()
    assert sorted(tuple(r) for r in got) == [(1, "Submitted", 2), (2, "Timeout", 1), (3, "Submitted", 1)]


def test_sessions_close_after_the_gap(spark):
    rows = [sample(0, 0), sample(5, 0), sample(100, 0), sample(100, 1)]
    later = [sample(60 * 24 * 4, 0)]
    runs = metrics.run_sessions(feed(spark, SAMPLES, rows, later), ["host"], gap="30 minutes", watermark="2 days")
    closed = all_rows(spark, drain(runs, "append")).orderBy("run_start").collect()
    table = metrics.table_sessions(spark.createDataFrame(rows, SAMPLES), ["host"], gap_seconds=1800)
    assert table.select("host", "run_start", "run_end", "events").orderBy("run_start").collect() == closed
    assert [(r.run_start, r.run_end, r.events) for r in closed] == [
        (at(0), at(35), 2), (at(100), at(130), 2)]


def test_instant_rate_is_compared_with_the_run(spark):
    rates = spark.createDataFrame([("h", 333.5), ("h", 200.0)], "host string, rate double")
    run = spark.createDataFrame([("h", 258.8)], "host string, sustained_rate double")
    got = metrics.instant_vs_sustained(rates, run, ["host"]).orderBy("rate").collect()
    assert [r.overstated for r in got] == [False, True]


def test_parse_progress_accepts_both_counter_orders(spark):
    df = spark.createDataFrame([("x 3/9 [00:10<1, error=1, ✓=2, ✖=0]",), ("x 4/9 [00:12<1, ✓=2, ✖=1, error=1]",)], "text string")
    got = parse_progress(df, F.lit("r")).orderBy("done").collect()
    assert [(r.ok, r.bad, r.error, r.elapsed_s) for r in got] == [(2, 0, 1, 10), (2, 1, 1, 12)]


@pytest.mark.parametrize("mode", ["append"])
def test_drain_replays_into_the_same_folder(spark, mode):
    stream = feed(spark, SAMPLES, [sample(0, 1)], [sample(1, 2)])
    assert all_rows(spark, drain(stream, mode)).count() == 2


@pytest.mark.parametrize(
    "name",
    ["ingest_results_stream", "wedge_detector", "counter_rate", "idle_gate", "instant_vs_sustained", "run_sessions"],
)
def test_archive_of_many_files_is_complete(spark, sf, name):
    """200 files in no order of time: several batches, nothing late, open runs included."""
    import os

    from tallywright.queries.catalogue import QUERIES, SQL
    from tallywright.workspace import shared_dir
    from tests.compare import difference, duck

    folder = shared_dir(spark, "archive")
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(200, "event_id").write.option("compression", "none").parquet(f"{folder}/events.parquet")
    assert sum(f.startswith("part-") for f in os.listdir(f"{folder.removeprefix('file://')}/events.parquet")) > 128
    assert difference(QUERIES[name](spark, folder), duck(sf), SQL[name]) is None


def test_progress_query_reads_one_file_per_run(spark, sf, monkeypatch):
    from tallywright.queries import live

    folders, write = [], live._write_lines
    monkeypatch.setattr(live, "_write_lines", lambda *a: folders.append(write(*a)) or folders[-1])
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        runs = live.progress_stream(spark, sf).count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = spark.read.option("recursiveFileLookup", "true").text(folders[0]).select("_metadata.file_path").distinct()
    assert files.count() == runs


def test_many_small_progress_logs_make_one_batch(spark, tmp_path):
    for k in range(70):
        (tmp_path / f"run{k}.log").write_text(f"x | {k}/100 [01:00<50:38, 34.5s/it, ✓=1, ✖=0, error=0]\n")
    run = F.regexp_extract("file", r"/([^/]+)\.log$", 1)
    out = drain(verdicts.progress_stream(verdicts.progress_source(spark, str(tmp_path)), run), "update")
    got = spark.read.parquet(out)
    assert got.count() == 70 and got.select("batch").distinct().count() == 1
