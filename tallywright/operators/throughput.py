"""Requests, sweep levels and what the curve over levels says."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions.statistics import gain, time_per_output_token
from tallywright.operators.keys import join_on
from tallywright.operators.quantiles import exact_quantiles
from tallywright.operators.running import running
from tallywright.workspace import settle

# The sweep's published rules.
PLATEAU_GAIN = 0.05
INTERACTIVE_TPOT_MS = 100.0
COSTLY_TTFT_RATIO = 2.0
COLLAPSE_FACTOR = 250.0
LATENCY_QUANTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


def latency_summary(requests: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, population deviation and exact interpolated percentiles per group."""
    v = F.col(value).cast("double")
    moments = requests.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")
    )
    return join_on(
        exact_quantiles(requests, keys, value, LATENCY_QUANTILES), moments, keys, "inner"
    )


def index_percentiles(requests: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Percentiles by the sorted-index rule, plus the extremes."""
    v = F.col(value).cast("double")
    ends = requests.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys).agg(
        F.min(v).alias("min"), F.max(v).alias("max")
    )
    ranked = exact_quantiles(requests, keys, value, {"p50": 0.5, "p90": 0.9}, rule="index")
    return join_on(ranked, ends, keys, "inner")


def level_throughput(
    requests: DataFrame, keys: Sequence[str], start: str = "ts_start", end: str = "ts_end",
    in_tok: str = "in_tok", out_tok: str = "out_tok",
) -> DataFrame:
    """Token and request rates over the wall time a level took."""
    out = requests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("completed"),
        F.sum(out_tok).alias("_out"),
        F.sum(in_tok).alias("_in"),
        ((F.unix_micros(F.max(end)) - F.unix_micros(F.min(start))) / 1e6).alias("duration_s"),
    )
    wall = F.col("duration_s")
    return out.select(
        *keys,
        "completed",
        "duration_s",
        F.try_divide(F.col("_out"), wall).alias("out_tok_s"),
        F.try_divide(F.col("_out") + F.col("_in"), wall).alias("total_tok_s"),
        F.try_divide(F.col("completed"), wall).alias("req_s"),
    )


def request_latency(requests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean time per output token and per-request rate of each group.

    Expects ``e2e_ms``, ``ttft_ms`` and ``out_tok``.
    """
    tpot = time_per_output_token(F.col("e2e_ms"), F.col("ttft_ms"), F.col("out_tok"))
    return requests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(tpot).alias("mean_tpot_ms"),
        F.avg("ttft_ms").alias("mean_ttft_ms"),
        F.avg(F.try_divide(F.col("out_tok") * 1000, F.col("e2e_ms"))).alias("tok_s_per_user"),
    )


def per_user_rate(levels: DataFrame, level: str = "concurrency", rate: str = "out_tok_s") -> DataFrame:
    """What one of ``level`` users sees of a level's output rate; null for a level of none.

    The mean rate of single requests (:func:`request_latency`) leaves out the time between a user's requests.
    """
    return levels.withColumn("tok_s_per_user", F.try_divide(F.col(rate), F.col(level)))


def peak_rate(
    requests: DataFrame, keys: Sequence[str], ts: str, tokens: str, width: str = "1 second"
) -> DataFrame:
    """Most tokens that fell into one time bucket."""
    buckets = requests.groupBy(*keys, F.window(ts, width).alias("_w")).agg(
        F.sum(tokens).alias("_t")
    )
    return buckets.groupBy(*keys).agg(
        F.max("_t").alias("peak"), F.count(F.lit(1)).alias("busy_buckets")
    )


def peak_concurrency(
    requests: DataFrame, keys: Sequence[str], start: str, end: str, chunk_seconds: int = 3600
) -> DataFrame:
    """Most requests in flight at once; an interval includes its start only.

    The sum of starts and ends runs over time chunks, so that a busy system
    spreads over many tasks.
    """
    width = chunk_seconds * 1_000_000
    edges = requests.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.unix_micros(start).alias("t"), F.lit(1).cast("bigint").alias("d")),
                F.struct(F.unix_micros(end).alias("t"), F.lit(-1).cast("bigint").alias("d")),
            )
        ).alias("_e"),
    ).select(*keys, F.col("_e.t").alias("_t"), F.col("_e.d").alias("_d"))
    # Ends sort before starts at the same instant, so the sum never counts both.
    level = running(
        edges, keys, ["_t", "_d"], F.floor(F.col("_t") / width), sums={"_level": F.col("_d")}
    )
    return level.groupBy(*keys).agg(F.max("_level").alias("peak_concurrency"))


def overlap_contamination(
    runs: DataFrame,
    loads: DataFrame,
    host: str,
    run_id: str,
    start: str,
    end: str,
    chunk_seconds: int = 86400,
) -> DataFrame:
    """How many other loads overlapped each benchmark window, and for how long.

    Nothing is paired up. For a window ``[s, e)`` the overlapping loads number
    (starts before e) - (ends at or before s), and the shared time is the
    integral of the load count from s to e. Both come from running sums over
    the ordered edges, so the work is linear in the input even when everything
    happens on one host. Adds ``n_overlaps`` and ``overlap_s``.
    """
    def edge(kind: int, t: Column, **sums: Column) -> Column:
        # kind orders edges at one instant: window end, load edge, window start.
        cols = {"n_start": F.lit(0), "n_end": F.lit(0), "t_start": F.lit(0), "t_end": F.lit(0)}
        cols.update(sums)
        return F.struct(
            t.alias("t"),
            F.lit(kind).alias("kind"),
            *[
                c.cast("decimal(20,0)" if n.startswith("t_") else "bigint").alias(n)
                for n, c in cols.items()
            ],
        )

    s, e = F.unix_micros(start), F.unix_micros(end)
    load_edges = loads.select(
        F.col(host).alias("_host"),
        F.lit(None).cast(runs.schema[run_id].dataType).alias("_run"),
        F.explode(
            F.array(edge(1, s, n_start=F.lit(1), t_start=s), edge(1, e, n_end=F.lit(1), t_end=e))
        ).alias("e"),
    )
    run_edges = runs.select(
        F.col(host).alias("_host"),
        F.col(run_id).alias("_run"),
        F.explode(F.array(edge(2, s), edge(0, e))).alias("e"),
    )
    edges = load_edges.unionByName(run_edges).select("_host", "_run", "e.*")
    # Edges that tie in both are all loads or all window edges of one sort, and
    # sums are read at window edges only, so any order among them is right.
    summed = running(
        edges,
        ["_host"],
        ["t", "kind"],
        F.floor(F.col("t") / (chunk_seconds * 1_000_000)),
        sums={f"c_{c}": F.col(c) for c in ("n_start", "n_end")}
        # Sums of microseconds since 1970 leave 64 bits after some 5,000 loads.
        | {f"c_{c}": F.col(c).cast("decimal(20,0)") for c in ("t_start", "t_end")},
    )
    area = (
        F.col("t").cast("decimal(18,0)") * (F.col("c_n_start") - F.col("c_n_end")) - F.col("c_t_start") + F.col("c_t_end")
    )
    at = summed.where(F.col("kind") != 1).groupBy("_host", "_run").agg(
        F.max(F.when(F.col("kind") == 0, F.col("c_n_start"))).alias("_starts"),
        F.max(F.when(F.col("kind") == 2, F.col("c_n_end"))).alias("_ends"),
        F.max(F.when(F.col("kind") == 0, area)).alias("_area_e"),
        F.max(F.when(F.col("kind") == 2, area)).alias("_area_s"),
    )
    return at.select(
        F.col("_host").alias(host),
        F.col("_run").alias(run_id),
        (F.col("_starts") - F.col("_ends")).alias("n_overlaps"),
        ((F.col("_area_e") - F.col("_area_s")).cast("double") / 1e6).alias("overlap_s"),
    )


def _along(system: str, level: str):
    # One row per level: a sweep has at most a few hundred, whatever the request count.
    return Window.partitionBy(system).orderBy(level)


def gain_vs_prev(
    levels: DataFrame, system: str = "system", level: str = "concurrency",
    rate: str = "out_tok_s",
) -> DataFrame:
    """Relative throughput change to the previous level; null for the first."""
    return levels.withColumn("gain", gain(F.col(rate), F.lag(rate).over(_along(system, level))))


def find_plateau(
    levels: DataFrame, system: str = "system", level: str = "concurrency",
    rate: str = "out_tok_s", threshold: float = PLATEAU_GAIN,
) -> DataFrame:
    """First level whose gain and all later gains stay below the threshold.

    Looking at later gains keeps a transient dip from passing for the plateau.
    """
    gains = gain_vs_prev(levels, system, level, rate)
    onward = _along(system, level).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    marked = gains.withColumn("_rest", F.max("gain").over(onward)).withColumn(
        "_flat", F.col("gain").isNotNull() & (F.col("_rest") < threshold)
    )
    return marked.groupBy(system).agg(
        F.min(F.when(F.col("_flat"), F.col(level))).alias("plateau_level"),
        F.max_by(rate, level).alias("last_rate"),
        F.max(rate).alias("peak_rate"),
        F.when(F.max(F.col("_flat").cast("int")) == 1, "plateau")
        .otherwise("still climbing")
        .alias("state"),
    )


def flag_flat_spot(
    levels: DataFrame, system: str = "system", level: str = "concurrency",
    rate: str = "out_tok_s", threshold: float = PLATEAU_GAIN,
) -> DataFrame:
    """Levels that stall although the curve climbs before and after them."""
    w = _along(system, level)
    gains = gain_vs_prev(levels, system, level, rate)
    around = gains.withColumn("prev_gain", F.lag("gain").over(w)).withColumn(
        "next_gain", F.lead("gain").over(w)
    )
    climbs_before = F.coalesce(F.col("prev_gain") >= threshold, F.lit(True))
    return around.withColumn(
        "flat_spot",
        F.coalesce(
            (F.col("gain") < threshold) & (F.col("next_gain") >= threshold) & climbs_before,
            F.lit(False),
        ),
    )


def flag_warmup(
    levels: DataFrame, system: str = "system", level: str = "concurrency",
    rate: str = "out_tok_s", p99: str = "p99_ttft_ms", spike: float = 2.0,
) -> DataFrame:
    """Levels that fall back, rebound at the next level, and show a tail spike."""
    w = _along(system, level)
    before, after = F.lag(rate).over(w), F.lead(rate).over(w)
    return levels.withColumn(
        "rebound", F.coalesce((F.col(rate) < before) & (after > before), F.lit(False))
    ).withColumn(
        "p99_spike", F.coalesce(F.col(p99) >= spike * F.lag(p99).over(w), F.lit(False))
    ).withColumn("warmup", F.col("rebound") & F.col("p99_spike"))


def at_matched_level(
    levels: DataFrame, reference: str, system: str = "system", level: str = "concurrency",
    rate: str = "out_tok_s",
) -> DataFrame:
    """Every system against a reference at equal concurrency."""
    ref = levels.where(F.col(system) == reference).select(level, F.col(rate).alias("reference_rate"))
    own = levels.where(F.col(system) != reference).select(system, level, F.col(rate).alias("rate"))
    return join_on(own, ref, [level], "inner").withColumn(
        "ratio", F.try_divide(F.col("rate"), F.col("reference_rate"))
    )


def slo_operating_point(
    levels: DataFrame, slo: float = INTERACTIVE_TPOT_MS, system: str = "system",
    level: str = "concurrency", rate: str = "out_tok_s", tpot: str = "tpot_ms",
) -> DataFrame:
    """Highest level that meets the latency objective, and its throughput.

    A system that never meets it keeps a row with nulls.
    """
    meets = F.col(tpot) < slo
    best = F.when(meets, F.col(level))
    return levels.groupBy(system).agg(
        F.max(best).alias("operating_level"),
        F.max_by(rate, best).alias("rate_at_slo"),
        F.max_by(tpot, best).alias("tpot_at_slo"),
    )


def claim_type(
    levels: DataFrame, system: str = "system", level: str = "concurrency",
    rate: str = "out_tok_s", ttft: str = "ttft_ms", threshold: float = PLATEAU_GAIN,
    cost: float = COSTLY_TTFT_RATIO,
) -> DataFrame:
    """Sustained peak and practical peak of each curve.

    The practical peak is the last level before one that adds less than the
    threshold at ``cost`` times the time to first token or more.
    """
    w = _along(system, level)
    nxt = gain(F.lead(rate).over(w), F.col(rate))
    dear = (nxt < threshold) & (F.lead(ttft).over(w) >= cost * F.col(ttft))
    marked = levels.withColumn("_stop", F.when(F.coalesce(dear, F.lit(False)), F.col(level)))
    first = F.min(F.struct(F.col("_stop").isNull().alias("none"), level, F.col(rate).alias("rate")))
    peak = F.max(F.struct(F.col(rate).alias("rate"), (-F.col(level)).alias("neg")))
    out = marked.groupBy(system).agg(first.alias("_f"), peak.alias("_p"))
    stops = ~F.col("_f.none")
    return out.select(
        system,
        F.col("_p.rate").alias("sustained_peak"),
        (-F.col("_p.neg")).alias("sustained_level"),
        F.when(stops, F.col("_f.rate")).otherwise(F.col("_p.rate")).alias("practical_peak"),
        F.when(stops, F.col(f"_f.{level}")).otherwise(-F.col("_p.neg")).alias("practical_level"),
        F.when(stops, "practical below sustained").otherwise("same").alias("claim"),
    )


def idle_before_level(levels: DataFrame, running_before: str) -> DataFrame:
    """Whether the engine was known to be idle when a level began."""
    state = F.when(F.col(running_before).isNull(), "unknown").when(
        F.col(running_before) == 0, "idle"
    ).otherwise("busy")
    return levels.withColumn("start_state", state)


def collapse_ratio(
    requests: DataFrame, keys: Sequence[str], ts: str, tokens: str, seconds: int = 3600,
    factor: float = COLLAPSE_FACTOR,
) -> DataFrame:
    """Time buckets whose throughput fell far below the group's median bucket.

    The buckets between two with requests in which nothing at all was served are one row: ``buckets``
    counts them, ``bucket`` is the first. The median is over the buckets with requests.
    """
    width = seconds * 1_000_000
    slot = F.floor(F.unix_micros(ts) / width).alias("_slot")
    found = settle(requests.groupBy(*keys, slot).agg(F.sum(tokens).alias("tokens")), "throughput-buckets")
    medians = exact_quantiles(found, keys, "tokens", {"median": 0.5}).select(*keys, "median")
    missing = F.lead("_slot").over(Window.partitionBy(*keys).orderBy("_slot")) - F.col("_slot") - 1
    own = F.struct(F.col("_slot").alias("at"), F.lit(1).cast("bigint").alias("n"), F.col("tokens").alias("t"))
    gap = F.struct((F.col("_slot") + 1).alias("at"), F.col("_missing").alias("n"), F.lit(0).cast(found.schema["tokens"].dataType).alias("t"))
    listed = found.withColumn("_missing", missing).select(
        *keys, F.explode(F.when(F.col("_missing") > 0, F.array(own, gap)).otherwise(F.array(own))).alias("_b")
    )
    out = join_on(listed, medians, keys, "inner").select(
        *keys,
        F.timestamp_micros(F.col("_b.at") * width).alias("bucket"),
        F.col("_b.n").alias("buckets"),
        F.col("_b.t").alias("tokens"),
        "median",
    )
    ratio = F.try_divide(F.col("median"), F.col("tokens"))
    return out.withColumn("times_below", ratio).withColumn(
        "collapsed", F.coalesce(ratio >= factor, F.col("tokens") == 0)
    )
