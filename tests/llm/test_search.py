"""Passages of a benchmark and ranked search against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from tallywright.llm import decontamination, ranking
from tests.llm.cases import edge_frame, edge_rows, no_rows, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_hits(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        if w:
            for k in range(max(1, len(w) - 9)):
                windows[tuple(w[k : k + 10])].add(item)
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (gram := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[gram]
        names = sorted(str(x) for x in found if x is not None)
        digest = hashlib.sha256(",".join(names).encode()).hexdigest()
        out.append((-1 if doc is None else doc, len(w), len(hit), len(names), digest, bool(hit)))
    return sorted(out)


def search_case() -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(6)
    items = [(k, prose(rng, rng.randint(1, 40), "abé1")) for k in range(30)]
    items += [(40, "A"), (41, "Two, Words!"), (42, ""), (43, None), (44, "..."), (45, "nine of the words here are not ten ok")]
    items += [(46, "one two three four five six seven eight nine ten"), (47, "ONE two three four five six seven eight nine ten eleven")]
    items += [(46, "another text of item forty six with more than ten words in it"), (None, "an item that has no id but has its ten words anyway")]
    items += [(48, items[3][1]), (49, "z" * 400), (50, "same " * 30)]
    docs = [(r[0], r[1]) for r in edge_rows()]
    docs += [(100, "xx one two three four five six seven eight nine ten eleven yy"), (101, "one-two.THREE four|five six seven eight nine ten")]
    docs += [(102, "one two three four five six seven eight nine tenx"), (103, "same " * 12), (104, "z" * 400), (105, "a an item that has no id but has its ten words anyway")]
    docs += [(106, "two words two words"), (107, "x" * 5), (108, "same " * 9 + "\n" + "same " * 9), (109, "another text of item forty six with more than ten words in it")]
    for k in range(120):
        w = prose(rng, rng.randint(0, 80), "abé1").split()
        for _ in range(rng.randint(0, 3)):
            item = words(rng.choice(items)[1])
            a, b = sorted((rng.randint(0, len(item)), rng.randint(0, len(item))))
            at = rng.randint(0, len(w))
            w[at:at] = item[a:b]
        docs.append((200 + k, rng.choice([" ", ", ", " \n"]).join(w)))
    return docs, items


def test_passages_equal_brute_force(spark, monkeypatch):
    docs, items = search_case()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    tests = spark.createDataFrame(items, "item_id long, text string")
    want = plain_hits(docs, items)

    def got(**options):
        found = decontamination.contaminated_documents(frame, tests, **options)
        return sorted(tuple(r) for r in found.na.fill(-1, ["doc_id"]).collect())

    assert got() == want
    assert got(words_at_once=300) == want  # several passes
    monkeypatch.setattr(decontamination, "LANES", 3)  # long walks
    passages = decontamination.Passages([(None if k is None else str(k), t and t.encode()) for k, t in items])
    found = passages.search([t and t.encode() for _, t in docs])
    plain = [(-1 if k is None else k, n, sum(b - a for a, b in spans), len(names)) for (k, _), (n, spans, names) in zip(docs, found)]
    assert sorted(plain) == [w[:4] for w in want]


def test_spans_tile_hits_and_edges(spark):
    docs, items = search_case()
    tests = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_passages(edge_frame(spark), tests).collect()
    assert len(found) == len(edge_rows())
    for row in found:
        ends = [x for s in row["spans"] for x in (s["from"], s["to"])]
        assert ends == sorted(set(ends)) and all(0 <= x <= row["n_words"] for x in ends)
    assert decontamination.contaminated_documents(no_rows(spark), tests).count() == 0
    clean = decontamination.contaminated_documents(edge_frame(spark), tests.filter("false"))
    assert {r["n_hit"] for r in clean.collect()} == {0}
    odd = spark.createDataFrame([("x", "ten words of an item with a text as its id", 1)], "item_id string, text string, doc_id int")
    assert decontamination.contaminated_documents(edge_frame(spark), odd).filter("contaminated").count() == 0


@pytest.mark.parametrize("block", [1, 2, 4])
def test_searcher_finds_every_occurrence(block, monkeypatch):
    import numpy as np

    monkeypatch.setattr(decontamination, "BLOCK", block)
    rng = random.Random(block)
    strings = list({"".join(rng.choice("ab ") for _ in range(rng.randint(4, 12))).encode() for _ in range(40)})
    text = "".join(rng.choice("ab ") for _ in range(5000)).encode()
    start, string = decontamination.Searcher(strings).occurrences(np.frombuffer(text, np.uint8))
    want = {(k, j) for j, s in enumerate(strings) for k in range(len(text)) if text.startswith(s, k)}
    assert set(zip(start.tolist(), string.tolist())) == want and len(start) == len(want)


def plain_ranks(docs: list[tuple], items: list[tuple], top: int = 10) -> list[tuple]:
    each = [(doc, Counter(words(text))) for doc, text in docs]
    sizes = [sum(c.values()) for _, c in each]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in each for t in c)
    out = []
    for item, text in items:
        scores = []
        for row, (doc, c) in enumerate(each):
            score = 0
            for t in words(text):
                if tf := c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((10**9 * tf) // (1000 * tf + 8 * (25 + (75 * sizes[row] * n_docs) // n_terms)))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, row))
        for rank, (score, none, doc, _) in enumerate(sorted(scores)[:top], 1):
            out.append((str(item), rank, None if none else doc, -score))
    return sorted(out, key=repr)


def rank_case() -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(3)
    vocabulary = prose(rng, 150, "abcdé9").split()
    usual = lambda n: " ".join(rng.choice(vocabulary[: rng.choice([3, 20, 150])]) for _ in range(n))
    docs = [(r[0], r[1]) for r in edge_rows()] + [(100 + k, usual(rng.randint(0, 70))) for k in range(500)]
    docs += [(700 + k, "Same Words, tied") for k in range(30)] + [(None, "same words tied"), (3, "same words tied"), (3, "same words tied")]
    items = [(k, usual(rng.randint(1, 40))) for k in range(25)] + [(30, "same words"), (31, None), (32, ""), (33, "zzzunknown"), (30, "tied tied")]
    return docs, [*items, (None, vocabulary[0]), (34, "word a two")]


def test_ranks_equal_brute_force(spark, monkeypatch):
    docs, items = rank_case()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    tests = spark.createDataFrame(items, "item_id long, text string")
    want = plain_ranks(docs, items)

    def got(**options):
        found = ranking.rank_documents(frame, tests, **options)
        return sorted([(str(r[0]), *r[1:]) for r in found.collect()], key=repr)

    assert got() == want
    monkeypatch.setattr(ranking, "ENTRIES", 1000)  # many blocks
    monkeypatch.setattr(ranking, "BUNDLE", 4)
    assert got(stages=7) == want
    assert got(top=3, stages=1) == plain_ranks(docs, items, 3)
    monkeypatch.setattr(ranking, "ITEMS_AT_ONCE", 12)  # several passes
    assert got() == want


def test_ranks_of_odd_tables(spark):
    docs, items = rank_case()
    tests = spark.createDataFrame(items, "item_id long, text string")
    assert ranking.rank_documents(no_rows(spark), tests).count() == 0
    assert ranking.rank_documents(edge_frame(spark), tests.filter("false")).count() == 0
    named = spark.createDataFrame([("x", "two words", 1, "r")], "item_id string, text string, rank int, score string")
    rows = [(r[0], r[1]) for r in edge_rows()]
    got = ranking.rank_documents(edge_frame(spark), named).collect()
    assert sorted([tuple(r) for r in got], key=repr) == plain_ranks(rows, [("x", "two words")])
