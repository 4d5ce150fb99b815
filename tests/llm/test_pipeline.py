"""The pipeline stage by stage, the registered queries, and their SQL."""

from __future__ import annotations

import random
from collections import defaultdict

import corpus_pipeline
import pytest
from tallywright.llm import queries
from tallywright.workspace import settle
from tests.compare import difference, duck
from tests.llm.cases import edge_frame, no_rows, prose
from tests.llm.test_near import plain_groups
from tests.llm.test_rules import quality_counts


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, sf, name):
    assert difference(queries.QUERIES[name](spark, sf), duck(sf), queries.SQL[name]) is None


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_stages_take_effect(spark):
    rng = random.Random(8)
    stop = "the of and to in is that".split()
    def text(n):
        return " ".join(w for x in prose(rng, n).split() for w in (x, rng.choice(stop)))
    clean = [(i, text(60), "en", "ab"[i % 2], 1) for i in range(40)]
    copies = [(100 + i, clean[i % 5][1], "en", "a", 1) for i in range(20)]
    junk = [(200 + i, "# $ " * 60, "en", "b", 1) for i in range(5)]
    private = [(300, text(40) + " write to me@mail.org or 10.0.0.1", "en", "a", 1)]
    docs = spark.createDataFrame(clean + copies + junk + private, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, settle(stage(spark, docs, ""), "test-stage")
        kept[name] = docs
        if name != "packing":
            assert docs.columns == before.columns
    ids = [r["doc_id"] for r in kept["quality_rules"].collect()]
    assert sorted(ids) == sorted(r[0] for r in clean + copies + private)
    assert sorted(r["doc_id"] for r in kept["near_duplicates"].collect()) == sorted(r[0] for r in clean + private)
    masked = kept["personal_data"].filter("doc_id = 300").first()["text"]
    assert masked.endswith("write to [EMAIL] or [IP]")
    words = defaultdict(int)
    for r in kept["mixing"].collect():
        words[r["source"]] += len(r["text"].split())
    assert abs(sum(words.values()) - 1.5 * sum(len(r["text"].split()) for r in kept["personal_data"].collect())) <= 2
    assert kept["packing"].groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0


def test_near_duplicates_go_by_the_method_of_op7_too(spark):
    rng = random.Random(14)
    cycle = "the copper ferry left harbour " * 30
    rows = [(i, cycle + prose(rng, 12), "en", "a", 1) for i in (5, 3, 9)] + [(4, prose(rng, 80), "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert len({r["component_id"] for r in queries.simhash.near_duplicates(docs).collect()}) == 2
    assert sorted(r["doc_id"] for r in corpus_pipeline.unlike_documents(spark, docs, "").collect()) == [3, 4]


def test_stages_take_edge_rows_and_none(spark):
    for docs in (edge_frame(spark), no_rows(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = settle(stage(spark, docs, ""), "test-edge")
        assert docs.count() >= 0


def test_filters_equal_brute_force_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = settle(corpus_pipeline.good_documents(spark, docs, sf), "test-good")
    failed = {r["doc_id"] for r in docs.collect() if (c := quality_counts(r["text"]))[0] < 20 or 100 * c[4] > 30 * c[0]}
    rows = good.collect()
    assert not failed & {r["doc_id"] for r in rows}
    texts = {r["doc_id"]: r["text"] for r in rows}
    assert len(texts) == len(rows)
    left = sorted(r["doc_id"] for r in corpus_pipeline.unlike_documents(spark, good, sf).collect())
    assert left == sorted(set(plain_groups(texts).values()))
