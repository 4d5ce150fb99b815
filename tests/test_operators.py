"""Operators against brute force, on skewed and awkward inputs."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallywright.functions import answers, parsing
from tallywright.operators import (
    attempts, comparison, contamination, running, sampling, scoring, throughput, trust, verdicts,
)
from tallywright.operators.bloom import bloom_words, maybe_in
from tallywright.operators.quantiles import exact_quantiles


def skewed(n=3000, seed=1):
    """Three keys and a null one; one key holds most rows."""
    rng = random.Random(seed)
    keys = ["hot"] * 8 + ["b", None]
    return pd.DataFrame(
        {
            "k": [rng.choice(keys) for _ in range(n)],
            "t": list(range(n)),
            "v": [rng.choice([0.0, -3.5, 7.25, rng.gauss(0, 50), 10 ** rng.uniform(-3, 6)])
                  for _ in range(n)],
        }
    )


@pytest.mark.parametrize("rule", ["interpolated", "index"])
def test_quantiles_match_numpy(spark, rule):
    pdf = skewed()
    probs = {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p99": 0.99}
    out = exact_quantiles(spark.createDataFrame(pdf), ["k"], "v", probs, rule).collect()
    assert len(out) == 3
    for r in out:
        values = np.sort(pdf[pdf.k.isna() if r.k is None else pdf.k == r.k].v.to_numpy())
        assert r.n == len(values)
        for name, p in probs.items():
            want = np.quantile(values, p) if rule == "interpolated" else values[int(p * len(values))]
            assert getattr(r, name) == pytest.approx(want, rel=1e-12)


def test_quantiles_ignore_nulls_and_keep_single_rows(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", None), ("b", float("nan")), ("c", -1.0)], "k string, v double")
    got = {r.k: (r.n, r.m) for r in exact_quantiles(df, ["k"], "v", {"m": 0.5}).collect()}
    assert got == {"a": (1, 2.0), "c": (1, -1.0)}


def test_quantiles_of_extreme_values(spark):
    inf = float("inf")
    df = spark.createDataFrame([("a", x) for x in (-inf, -1e300, -0.0, 0.0, 5e-324, 1e300, inf)], "k string, v double")
    row = exact_quantiles(df, ["k"], "v", {"lo": 0.0, "q": 0.2, "m": 0.5, "hi": 0.99}, rule="index").first()
    assert (row.n, row.lo, row.q, row.m, row.hi) == (7, -inf, -1e300, 0.0, inf)


@pytest.mark.parametrize("width", [1, 7, 100, 10_000])
def test_running_equals_plain_window(spark, width):
    df = spark.createDataFrame(skewed(800)).withColumn("h", F.when(F.col("t") % 13 == 0, F.col("t")))
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    plain = df.select("k", "t", F.sum(F.col("t") % 5).over(w).alias("s"),
                      F.last("h", ignorenulls=True).over(w).alias("c"),
                      F.lag("t").over(Window.partitionBy("k").orderBy("t")).alias("p"))
    ours = running.running(df, ["k"], ["t"], F.floor(F.col("t") / width),
                           sums={"s": F.col("t") % 5}, carries={"c": F.col("h")},
                           previous={"p": F.col("t")}).select("k", "t", "s", "c", "p")
    assert ours.count() == 800
    assert ours.exceptAll(plain).count() == 0


def test_running_spreads_a_hot_key(spark):
    df = spark.range(1000).select(F.lit("hot").alias("k"), F.col("id").alias("t"))
    out = running.running(df, ["k"], ["t"], F.floor(F.col("t") / 50), sums={"s": F.lit(1)})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k#" in plan and "_chunk" in plan
    assert "Join" not in plan


def test_overlaps_match_brute_force(spark):
    rng = random.Random(4)
    base = pd.Timestamp("2030-01-01")
    def make(n, offset):
        starts = [rng.randint(0, 5000) for _ in range(n)]
        return pd.DataFrame({
            "host": [rng.choice(["x", "x", "x", "y"]) for _ in range(n)],
            "id": range(offset, offset + n),
            "s": [base + pd.Timedelta(seconds=s) for s in starts],
            "e": [base + pd.Timedelta(seconds=s + rng.choice([0, 5, 60, 900])) for s in starts],
        })
    runs, loads = make(60, 0), make(300, 1000)
    runs.loc[0, ["s", "e"]] = runs.loc[1, ["s", "e"]].to_numpy()
    out = throughput.overlap_contamination(
        spark.createDataFrame(runs), spark.createDataFrame(loads), "host", "id", "s", "e", chunk_seconds=120
    ).collect()
    assert len(out) == 60
    for r in out:
        run = runs[runs.id == r.id].iloc[0]
        hit = loads[(loads.host == run.host) & (loads.s < run.e) & (loads.e > run.s)]
        seconds = sum((min(a.e, run.e) - max(a.s, run.s)).total_seconds() for a in hit.itertuples())
        assert r.overlap_s == pytest.approx(seconds)
        if run.s < run.e:
            spans = hit[hit.s < hit.e]
            points = loads[(loads.host == run.host) & (loads.s == loads.e) & (loads.s > run.s) & (loads.s < run.e)]
            assert r.n_overlaps == len(spans) + len(points)


def test_overlap_of_ten_thousand_loads_at_once(spark):
    times = "timestamp'2030-01-01 00:00:00' AS s", "timestamp'2030-01-01 01:00:00' AS e"
    loads = spark.range(10_000).selectExpr("'x' AS host", "id", *times)
    runs = spark.range(1).selectExpr("'x' AS host", "id", *times)
    row = throughput.overlap_contamination(runs, loads, "host", "id", "s", "e").first()
    assert row.n_overlaps == 10_000 and row.overlap_s == 36_000_000.0


def test_measures_with_many_separators_and_marks(spark):
    cells = ["1,234,567", "~2,345,678", "~709 (c≈256)", "1,2345", "12,345.5 ms"]
    df = spark.createDataFrame([(c,) for c in cells], "c string").select(parsing.parse_measure(F.col("c")).alias("m"))
    got = [(r.m.value, r.m.qualifier) for r in df.collect()]
    assert got[0][0] == 1234567 and got[1] == (2345678, "~") and got[2] == (709, "~ c≈256")
    assert got[3][0] == 1 and got[4][0] == 12345.5


def test_twelve_choices_have_letters(spark):
    choices = F.array(*[F.lit(f"c{i}") for i in range(12)])
    rows = [spark.range(1).select(parsing.shuffle_choices(F.lit(5), choices, F.lit(f"c{i}"), 1).alias("s")).first().s.answer for i in range(12)]
    assert sorted(rows) == [f"({x})" for x in "ABCDEFGHIJKL"]


def test_slice_shares_of_few_items_add_up(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(5)], "i int, s string")
    got = {r.s: r.slice_share for r in sampling.slice_bias(df, "i", "s", 100, 1).collect()}
    assert got == {"a": 0.6, "b": 0.4}


def test_peak_concurrency_matches_brute_force(spark):
    rng = random.Random(5)
    base = pd.Timestamp("2030-01-01")
    starts = [rng.randint(0, 3000) for _ in range(400)]
    pdf = pd.DataFrame({"k": ["a"] * 400, "s": [base + pd.Timedelta(seconds=s) for s in starts],
                        "e": [base + pd.Timedelta(seconds=s + rng.randint(1, 400)) for s in starts]})
    want = max(((pdf.s <= t) & (pdf.e > t)).sum() for t in pdf.s)
    got = throughput.peak_concurrency(spark.createDataFrame(pdf), ["k"], "s", "e", chunk_seconds=60).first()
    assert got.peak_concurrency == want


@pytest.mark.parametrize("broadcast_bytes", [0, contamination.BROADCAST_BYTES])
def test_contamination_matches_brute_force(spark, broadcast_bytes):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(30)]
    def text(n):
        return " ".join(rng.choice(vocab) for _ in range(n))
    common = text(6)
    items = [(i, f"{text(5)} {common}\n{text(4)}".upper()) for i in range(12)] + [(99, "too short")]
    docs = [(i, f"{text(20)}  {common} {text(3)}" if i % 3 else text(25)) for i in range(90)]
    docs += [(500, items[0][1].lower()), (501, ""), (502, None)]
    n = 4
    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}
    corpus = spark.createDataFrame(docs, "doc long, text string")
    evals = spark.createDataFrame(items, "item long, text string")
    every = set().union(*(grams(t) for _, t in docs))
    got = {r.item: (r.n_grams, r.n_found) for r in
           contamination.item_contamination(corpus, evals, "doc", "item", n, broadcast_bytes).collect()}
    assert got == {i: (len(grams(t)), len(grams(t) & every)) for i, t in items if grams(t)}
    wanted = set().union(*(grams(t) for _, t in items))
    hits = {r.doc: r.n_hits for r in
            contamination.document_contamination(corpus, evals, "doc", "item", n, broadcast_bytes).collect()}
    assert hits == {i: len(grams(t) & wanted) for i, t in docs if grams(t) & wanted}


def test_bloom_filter_keeps_every_key_and_its_size(spark):
    bits, key = 10, F.xxhash64("id")
    held = spark.range(8 << bits)  # eight bits a key
    words = bloom_words(held.union(held), key, bits)
    assert words.count() <= 1 << bits
    asked = spark.range(-50_000, 8 << bits)
    passed = maybe_in(asked, key, words, bits)
    assert passed.columns == ["id"]
    n = passed.agg(F.count_if(F.col("id") >= 0).alias("own"), F.count_if(F.col("id") < 0).alias("other")).first()
    assert n.own == 8 << bits and n.other < 5_000
    assert maybe_in(asked, key, bloom_words(held.limit(0), key, bits), bits).count() == 0


def test_bootstrap_agrees_with_the_formula_and_repeats(spark):
    pdf = pd.DataFrame({"k": ["a"] * 400 + ["b"] * 50, "hit": [i % 4 == 0 for i in range(450)]})
    df = spark.createDataFrame(pdf).select("k", F.col("hit").cast("int").alias("hit"), F.lit(1).alias("one"))
    out = scoring.bootstrap_ci(df, ["k"], "hit", "one", iterations=2000).orderBy("k").collect()
    again = scoring.bootstrap_ci(df.repartition(5), ["k"], "hit", "one", iterations=2000).orderBy("k").collect()
    assert out == again
    for r in out:
        p = r.estimate
        assert r.stderr == pytest.approx((p * (1 - p) / r.n) ** 0.5, rel=0.15)
        assert r.low < p < r.high


def test_bootstrap_of_unlike_items_does_not_depend_on_partitions(spark):
    """Every item its own outcome, so that no two are merged; a null key, a key without trials, a null outcome."""
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": ["a"] * 1500 + ["b"] * 300, "hits": rng.integers(0, 1000, 1800), "trials": rng.integers(1000, 2000, 1800)})
    rows = [tuple(r) for r in pdf.astype(object).itertuples(index=False)]
    rows += [(None, 1, 2), (None, None, 3), (None, 0, 4), ("c", 0, 0)]
    df = spark.createDataFrame(rows, "k string, hits long, trials long")
    want = scoring.bootstrap_ci(df, ["k"], "hits", "trials", iterations=500).orderBy("k").collect()
    again = scoring.bootstrap_ci(df.repartition(7), ["k"], "hits", "trials", iterations=500, held=1).orderBy("k").collect()
    assert want == again and [r.k for r in want] == [None, "a", "b", "c"]
    for r in want[1:3]:
        own = pdf[pdf.k == r.k]
        ratio = own.hits.sum() / own.trials.sum()
        assert r.estimate == pytest.approx(ratio) and r.n == len(own) and r.low < ratio < r.high
        assert r.stderr == pytest.approx(((own.hits - ratio * own.trials) ** 2).sum() ** 0.5 / own.trials.sum(), rel=0.15)
    assert want[0].estimate == pytest.approx(1 / 9)
    assert (want[3].estimate, want[3].stderr, want[3].low, want[3].high) == (None, None, None, None)


def test_stderr_is_the_sample_error_and_null_for_one_row(spark):
    df = spark.createDataFrame([("a", True)] * 144 + [("a", False)] * 54 + [("b", True)], "k string, ok boolean")
    got = {r.k: r for r in scoring.score_summary(df, ["k"], "ok").collect()}
    p = 144 / 198
    assert got["a"].stderr == pytest.approx((p * (1 - p) / 197) ** 0.5, rel=1e-12)
    assert got["b"].stderr is None and got["b"].score == 1.0


def test_answer_rules(spark):
    rows = [
        ("The answer is (A). No, the answer is B", "B", "B"),
        ("I pick (B) but the answer is (C)", "C", "C"),
        ("so (D)", None, "D"),
        (None, None, None),
        ("maybe b", None, "B"),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, c string")
    c = answers.guard_null(F.col("c"))
    out = df.select("i", answers.extract_mcq(c).alias("m"), answers.extract_replay(c).alias("r")).orderBy("i").collect()
    assert [(o.m, o.r) for o in out] == [(m, r) for _, m, r in rows]
    n = spark.createDataFrame([("The answer is $1,200 then 7",)], "c string")
    assert n.select(answers.extract_number(F.col("c")), answers.extract_number_fallback(F.col("c"))).first() == ("1200", "7")
    g = n.select(answers.exact_match(F.lit("$1,200."), F.lit("x #### 1200"), regexes=answers.STOCK_IGNORE),
                 answers.gold_target(F.lit("3 + 4 #### 1,007 "))).first()
    assert tuple(g) == (True, "1007")


def test_parsing_rules(spark):
    one = spark.range(1)
    def val(col):
        return one.select(col.alias("v")).first().v
    assert val(parsing.parse_instance_id(F.lit("scikit-learn__scikit-learn-14710"))).asDict() == {
        "org": "scikit-learn", "repo": "scikit-learn", "number": 14710}
    assert val(parsing.parse_instance_id(F.lit("a_b__c_d-5"))).asDict() == {"org": "a_b", "repo": "c_d", "number": 5}
    m = val(parsing.parse_model_id(F.lit("lab/Net-3.5-Wide-30B-A3B-NVFP4")))
    assert (m.org, m.total_b, m.active_b, m.quantisation) == ("lab", 30.0, 3.0, "NVFP4")
    assert val(parsing.parse_duration(F.lit("9h15m"))) == 33300
    assert val(parsing.parse_duration(F.lit("518.9 s"))) == 518.9
    assert val(parsing.parse_duration(F.lit("n/a"))) is None
    assert val(parsing.parse_measure(F.lit("51/100⁵"))).denominator == 100.0
    assert val(parsing.split_reasoning(F.lit("<think>so\nlong</think> 42"))).asDict() == {
        "reasoning": "so\nlong", "answer": "42"}
    assert val(parsing.clean_text(F.lit(None).cast("string"))) == " "
    assert val(parsing.clean_text(F.lit(" a [title] b [x] c "))) == "a.  b c".replace("  ", " ")
    assert val(answers.tool_call_error(F.lit('{"a": 1'))) == "malformed"
    assert val(answers.tool_call_error(F.lit('{"a": 1}'))) is None


def test_replay_merge_overrides_only_known_items(spark):
    base = spark.createDataFrame([(1, "bad"), (2, "ok")], "i int, s string")
    replay = spark.createDataFrame([(1, "ok"), (9, "ok")], "i int, s string")
    got = sorted(map(tuple, verdicts.merge_reruns(base, replay, ["i"], ["s"]).collect()))
    assert got == [(1, "ok", "replay"), (2, "ok", "base")]


def test_champion_ignores_missing_scores(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, 2.0), (1, 3, None), (2, 1, None)], "p int, c int, s double")
    got = {r.p: (r.champion, r.n_scored) for r in attempts.pick_champion(df, ["p"], "c", "s").collect()}
    assert got == {1: (1, 2), 2: (None, 0)}


def test_memory_fit_matches_brute_force(spark):
    rng = random.Random(8)
    needs = [rng.uniform(0, 130) for _ in range(80)] + [100.5, 80_000.0, 60_000.0, 0.0]
    hosts = [rng.uniform(-5, 120) for _ in range(40)] + [100.7, 100_000.0, 100.5]
    m = spark.createDataFrame([(i, x) for i, x in enumerate(needs)], "i int, need double")
    h = spark.createDataFrame([(x,) for x in hosts], "gb double")
    for r in comparison.fits_memory(m, h, "need", "gb").collect():
        fit = [x for x in hosts if x >= needs[r.i]]
        assert r.n_hosts == len(fit) and r.smallest_fit_gb == (min(fit) if fit else None)
        assert r.fits == bool(fit)


def test_seeded_sample_is_stable(spark):
    df = spark.range(5000).withColumnRenamed("id", "i")
    a = {r.i for r in sampling.seeded_sample(df, "i", 50, 42).collect()}
    b = {r.i for r in sampling.seeded_sample(df.repartition(7), "i", 50, 42).collect()}
    c = {r.i for r in sampling.seeded_sample(df, "i", 50, 43).collect()}
    assert a == b and len(a) == 50 and a != c


def test_comparability_needs_one_reference_run(spark):
    df = spark.sql("""SELECT * FROM VALUES ('a', map('x', '1', 'y', '2')), ('b', map('x', '1', 'z', '3')),
                   ('c', map('x', '1', 'y', '2')) AS t(system, config)""")
    got = {tuple(r) for r in comparison.comparability_check(df, "a").collect()}
    assert got == {("b", "y", None, "2"), ("b", "z", "3", None)}
    flags = {r.system: r.comparable for r in comparison.comparable_systems(df, "a").collect()}
    assert flags == {"b": False, "c": True}


def test_failure_classes(spark):
    df = spark.createDataFrame([("LimitsExceeded",), ("RepeatedFormatError",), ("Odd",), (None,)], "s string")
    got = [r.c for r in df.select(trust.failure_class(F.col("s")).alias("c")).collect()]
    assert got == ["agent-budget", "infra", "unknown", "unknown"]


def test_hours_without_any_request_are_a_collapse(spark):
    from datetime import datetime, timedelta

    start = datetime(2026, 3, 1)
    rows = [("m", start + timedelta(hours=h, minutes=k), 100) for h in range(10) if h not in (5, 6) for k in (0, 20, 59)]
    rows += [("n", start + timedelta(hours=h), 10 if h else 1) for h in range(4)] + [("n", start + timedelta(days=900), 10)]
    found = throughput.collapse_ratio(spark.createDataFrame(rows, "system string, ts timestamp, out_tok int"), ["system"], "ts", "out_tok", factor=10)
    bad = sorted((r.system, (r.bucket - start) / timedelta(hours=1), r.buckets, r.tokens) for r in found.where("collapsed").collect())
    assert bad == [("m", 5, 2, 0), ("n", 0, 1, 1), ("n", 4, 900 * 24 - 4, 0)]
    assert found.where("not collapsed").count() == 8 + 4


@pytest.mark.parametrize("rule", ["interpolated", "index"])
def test_percentiles_of_values_close_together(spark, rule):
    """Narrow ranges are split until a bucket is small; ties, infinities and outliers don't hinder that."""
    rng = np.random.default_rng(3)
    groups = {
        "tiny": rng.random(9000) * 1e-5,
        "clock": 1.7e15 + rng.integers(0, 10**8, 9000).astype(float),
        "ties": np.concatenate([np.full(6000, 3e-6), rng.random(3000) * 1e-5]),
        "spread": np.concatenate([rng.random(5000) * 1e-12, [np.inf, -np.inf, 1e300, -5.0]]),
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    probs = {"p1": 0.01, "p50": 0.5, "p90": 0.9, "p99": 0.99}
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", probs, rule=rule, most_rows=100).collect()}
    for g, values in groups.items():
        ordered = np.sort(values)
        for name, p in probs.items():
            want = ordered[min(int(p * len(ordered)), len(ordered) - 1)] if rule == "index" else float(np.quantile(ordered, p))
            assert got[g][name] == pytest.approx(want, rel=1e-12), (g, name)


def test_running_values_where_most_rows_share_a_second(spark):
    rng = random.Random(7)
    rows = [("a" if i % 3 else "b", 1000 if i % 10 else i, i, rng.choice([None, "x", "y"]), i % 5) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, s long, id int, header string, v int").withColumn("ts", F.timestamp_seconds("s"))
    def run(most):
        out = running.running(df.repartition(7), ["k"], ["ts", "id"], running.time_chunk("ts"), sums={"total": F.col("v").cast("bigint")},
                      carries={"last": F.col("header")}, previous={"before": F.col("header")}, most_rows=most)
        return sorted(map(tuple, out.select("k", "id", "total", "last", "before").collect()))
    plain, split = run(1 << 20), run(200)
    assert plain == split
    totals, last, before = {}, {}, {}
    want = []
    for k, s, i, h, v in sorted(rows, key=lambda r: (r[1], r[2])):
        totals[k] = totals.get(k, 0) + v
        before[k] = last.get(k)
        last[k] = h if h is not None else last.get(k)
        want.append((k, i, totals[k], last[k], before[k]))
    assert plain == sorted(want)


def test_differing_settings_with_their_values(spark):
    runs = [("a", {"util": "0.9", "seed": "1"}), ("b", {"util": "0.55", "seed": "1"}), ("c", {"util": "0.9", "seed": "1", "spec": "on"})]
    df = spark.createDataFrame(runs, "run string, config map<string,string>")
    got = sorted(tuple(r) for r in comparison.config_values(df).na.fill("-").collect())
    assert got == [("spec", "-", 2), ("spec", "on", 1), ("util", "0.55", 1), ("util", "0.9", 2)]


def test_models_of_one_size_fit_alike(spark):
    models = spark.createDataFrame([(i, 80.0) for i in range(300)] + [(301, None), (302, 200.0), (303, 8.0)], "m int, need double")
    hosts = spark.createDataFrame([(24.0,), (80.0,), (96.0,), (96.0,), (-1.0,), (None,)], "usable double")
    got = {r.m: (r.n_hosts, r.smallest_fit_gb, r.fits) for r in comparison.fits_memory(models, hosts, "need", "usable").collect()}
    assert len(got) == 303 and {got[i] for i in range(300)} == {(3, 80.0, True)}
    assert got[301] == (0, None, False) and got[302] == (0, None, False) and got[303] == (4, 24.0, True)


def test_running_gives_a_task_no_more_rows_as_tables_grow(spark, monkeypatch):
    from tallywright.operators import running as module

    monkeypatch.setattr(module, "TASK_ROWS", 50)
    frame = spark.range(2000).select((F.col("id") % 40).alias("k"), F.col("id").alias("at"))
    out = module.running(frame, ["k"], ["at"], F.lit(0), sums={"n": F.lit(1).cast("bigint")})
    assert out.rdd.getNumPartitions() >= 40  # all were one task, merged by their few bytes
    assert sorted(r["n"] for r in out.collect()) == sorted([*range(1, 51)] * 40)
