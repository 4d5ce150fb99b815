"""Shape of the physical plans: no cross products, pruned scans, few shuffles."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry

QUERIES = entry.queries()
# Queries that build their plan only after writing files or running a stream.
EAGER = ("read_", "write_")


def plan(spark, sf, name):
    return QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(EAGER)))
def test_no_cross_product(spark, sf, name):
    text = plan(spark, sf, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_read_only_what_is_used(spark, sf):
    text = plan(spark, sf, "find_plateau")
    assert "l_comment" not in text and "l_shipdate" not in text
    text = plan(spark, sf, "null_rate_gate")
    assert "lang" not in text.split("ReadSchema")[1]


def test_filters_reach_the_scan(spark, sf):
    text = plan(spark, sf, "overlap_contamination")
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,purchase)]" in text


@pytest.mark.parametrize("name, shuffles", [
    ("score_summary", 1), ("truncation_curve", 1), ("quality_card", 1), ("last_status_wins", 1),
    ("pick_champion", 1), ("round_progress", 2), ("leaderboard", 2), ("verdict_card", 2),
    ("same_sample", 4), ("seeded_sample", 0), ("peak_concurrency", 4),
])
def test_shuffle_count(spark, sf, name, shuffles):
    text = plan(spark, sf, name)
    assert text.count("Exchange hashpartitioning") + text.count("Exchange SinglePartition") <= shuffles
