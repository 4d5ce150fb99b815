"""SimHash, embedding and byte-string duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import xxhash
from tallywright.llm import copies, graph, simhash, suffixes, vectors
from tallywright.workspace import settle
from tests.llm.cases import edge_frame, edge_rows, no_rows, prose


def classes(nodes: list, links) -> dict:
    low = {n: n for n in nodes}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 7), (3, 9), (9, 3), (3, 9)]
    rng.shuffle(links)
    frame = spark.createDataFrame([*links, (None, 4)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(frame, "a", "b").collect()}
    want = classes(sorted({x for e in links for x in e}), links)
    assert got == {k: v for k, v in want.items() if k != 7}
    assert graph.components(frame.filter("false"), "a", "b").count() == 0


def plain_fingerprint(text: str | None) -> int:
    data = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", data) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    values = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def near_texts() -> list[tuple]:
    rng = random.Random(2)
    rows = [(r[0], r[1]) for r in edge_rows() if r[0] is not None and r[0] != 11]
    base = [prose(rng, 120) for _ in range(8)]
    for i in range(120):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = prose(rng, 1)
        rows.append((100 + i, " ".join(words)))
    rows += [(300 + i, "same short text") for i in range(40)]
    return rows


def test_simhash_classes_equal_brute_force(spark):
    rows = near_texts()
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    fps = defaultdict(list)
    for doc, text in rows:
        fps[plain_fingerprint(text)].append(doc)
    firsts = list(fps)
    links = [(min(fps[a]), min(fps[b])) for a in firsts for b in firsts if a < b and (a ^ b).bit_count() <= 2]
    low = classes(sorted(min(x) for x in fps.values()), links)
    want = sorted((d, f"{f:016x}", low[min(docs)]) for f, docs in fps.items() for d in docs)
    assert sorted(tuple(r) for r in found) == want
    assert len({w[2] for w in want}) < len({w[1] for w in want})


def test_fingerprint_blocks_agree(monkeypatch):
    text = prose(random.Random(3), 500)
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text) == whole


def test_simhash_edges(spark):
    docs = edge_frame(spark)
    assert simhash.near_duplicates(docs).count() == docs.count()
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(None) == 1 and ids.count(10) == 1 and 1 not in ids and 0 in ids
    assert simhash.near_duplicates(no_rows(spark)).count() == 0


def vector_rows() -> list[tuple]:
    rng = np.random.default_rng(4)
    rows: list = []
    for c in rng.standard_normal((40, 24)):
        for _ in range(int(rng.integers(1, 9))):
            rows.append((c + rng.standard_normal(24) * rng.uniform(0.05, 0.35)).astype(np.float32).tolist())
    rows += [rows[0]] * 30 + [[2 * x for x in rows[1]]]
    rows += [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, rows[0][:12]]
    return [(i, r, "x") for i, r in enumerate(rows)]


def exact_links(rows: list[tuple]) -> list[tuple]:
    units = {}
    for i, r, _ in rows:
        x = None if r is None or None in r else np.array(r, np.float32).astype(float)
        if x is not None and len(x) and np.isfinite(x).all() and x.any():
            units[i] = x / np.linalg.norm(x)
    return [(a, b) for a in units for b in units if a != b and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.9]


def check_vectors(spark, rows) -> None:
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, key string")
    got = {r["vec_id"]: r for r in vectors.near_vectors(frame).collect()}
    links = exact_links(rows)
    low = classes([r[0] for r in rows], [(a, b) for a, b in links if a < b])
    found = sum(r["n_links"] for r in got.values())
    assert len(got) == len(rows) and 0.97 * len(links) <= found <= len(links)
    if found == len(links):
        assert all(r["component_id"] == low[i] and r["kept"] == (low[i] == i) for i, r in got.items())


def test_vectors_equal_brute_force(spark):
    check_vectors(spark, vector_rows())


def test_vectors_in_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 8)
    check_vectors(spark, vector_rows())


def test_vectors_empty_and_repeated(spark):
    schema = "vec_id long, embedding array<double>"
    assert vectors.near_vectors(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (None, None)]
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(got, key=str) == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 0, None, True)], key=str)


def plain_removal(rows: list[tuple], length: int = 400) -> list[tuple]:
    seen = defaultdict(list)
    data = [(t or "").encode() for _, t in rows]
    for r, d in enumerate(data):
        for p in range(len(d) - length + 1):
            seen[hash(d[p : p + length]), d[p : p + 8]].append((r, p))
    cut = [np.zeros(len(d) + 1, bool) for d in data]
    for at in seen.values():
        if len(at) > 1:
            for r, p in at:
                cut[r][p : p + length] = True
    out = []
    for (i, _), d, m in zip(rows, data, cut):
        m = m[:-1]
        rest = bytes(np.frombuffer(d, np.uint8)[~m]) if d else b""
        spans = int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())
        out.append((i, len(d), int(m.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def passage_rows() -> list[tuple]:
    rng = random.Random(5)
    shared = [prose(rng, 110) for _ in range(5)]
    rows: list = [(i, t) for i, t in enumerate([None, "", "x", "a" * 399, "a" * 400, "a" * 401, "ab" * 500, "y" * 3000, *shared[:1] * 2, shared[0][:450], shared[0][30:440]])]
    for _ in range(50):
        parts = [prose(rng, rng.randint(1, 80))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            start = rng.randint(0, max(0, len(p) - 410))
            p = p[start : start + rng.choice([380, 399, 400, 401, 402, 450, 600])]
            if rng.random() < 0.4:
                k = rng.randrange(len(p))
                p = p[:k] + "é" + p[k + 1 :]
            parts += [p, prose(rng, rng.randint(0, 40))]
        rows.append((len(rows), rng.choice(["", " "]).join(parts)))
    base = prose(rng, 250)
    for _ in range(15):
        words = base.split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = prose(rng, 1)
        rows.append((len(rows), " ".join(words)))
    return rows


def test_removal_equals_brute_force(spark):
    rows = passage_rows()
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_removal(rows)


def test_texts_are_worked_through_together():
    rng = random.Random(6)
    texts = [t.encode() for t in ["", "x" * 399, "y" * 400, "z" * 463, *(prose(rng, rng.randint(60, 200)) for _ in range(200))]]
    long = [t for t in texts if len(t) >= 400]
    alone = [suffixes.anchors([t])[1:] for t in long]
    whole = suffixes.anchors(long)
    assert whole[0].tolist() == [k for k, x in enumerate(alone) for _ in x[0]]
    assert all(got.tolist() == sum((x[c].tolist() for x in alone), []) for c, got in enumerate(whole[1:]))
    batch = pa.RecordBatch.from_arrays([pa.array(map(bytes, zip(range(len(texts))))), pa.array(texts, pa.string())], ["key", "text"])
    frame = SimpleNamespace(select=lambda *_: SimpleNamespace(mapInArrow=lambda run, schema: list(run(iter([batch])))))
    assert len(suffixes._read(frame)) < len(long) / 20


def test_removal_edges(spark):
    rows = [(r[0], r[1] if r[1] is None or len(r[1]) < 5_000 else r[1][:5_000]) for r in edge_rows()]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixes.remove_repeats(frame, keep_text=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == plain_removal(rows)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)
    assert suffixes.remove_repeats(no_rows(spark)).count() == 0


def near_copies() -> list[tuple]:
    """Texts of 204 words, so of 200 shingles; a changed word far from others changes five."""
    rng = random.Random(9)
    rows = []
    for group in range(6):
        base = prose(rng, 204).split()
        rows.append((100 * group, " ".join(base)))
        for n in (1, 2, 3, 4, 6, 9):
            words = list(base)
            for k in range(n):
                words[10 + 20 * k] = f"Other{group}x{n}x{k}"
            rows.append((100 * group + n, " ".join(words)))
    return rows


def plain_shingles(text: str | None) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def plain_groups(texts: dict) -> dict:
    """Node to smallest node of its group, by all pairs of exact sets."""
    sets = {k: plain_shingles(t) for k, t in texts.items()}
    near = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return classes(list(texts), near)


def test_near_copies_go_at_jaccard_of_four_fifths(spark):
    rows = near_copies()
    sets = {i: plain_shingles(t) for i, t in rows}
    near = {(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert all((g, g + n) in near for g in range(0, 600, 100) for n in (1, 2, 3, 4)) and not any(b % 100 > 4 for _, b in near)
    far = [(a, b) for a, b in near if (simhash.fingerprint(rows[0][1] if a == 0 else dict(rows)[a]) ^ simhash.fingerprint(dict(rows)[b])).bit_count() > 2]
    assert len(far) > len(near) / 2
    extra = [(900 + i, t.upper()) for i, (_, t) in enumerate(rows)] + [(None, rows[0][1]), (990, ""), (991, None)]
    frame = spark.createDataFrame(rows + extra, "doc_id long, text string")
    left = sorted(str(r["doc_id"]) for r in copies.one_of_each(frame).collect())
    assert left == sorted(map(str, [g + n for g in range(0, 600, 100) for n in (0, 6, 9)] + [None, 990]))


def group_texts() -> dict:
    """Copies of many degrees, chains of them, and texts that share passages or little else."""
    rng = random.Random(31)
    passages = [prose(rng, rng.randint(8, 60)).split() for _ in range(6)]
    texts = [prose(rng, rng.randint(1, 9)) for _ in range(20)]
    for _ in range(25):
        words = prose(rng, rng.randint(6, 90)).split()
        for _ in range(rng.randint(1, 9)):
            texts.append(" ".join(words))
            for _ in range(rng.randint(0, 2)):  # each copy of the one before, so ends of a chain differ
                words[rng.randrange(len(words))] = prose(rng, 1)
    for _ in range(60):  # mostly a common passage, with words of their own
        own = prose(rng, rng.randint(0, 12)).split()
        passage = rng.choice(passages)
        texts.append(" ".join(own[: len(own) // 2] + passage + own[len(own) // 2 :]))
    texts += [" ".join(sum(rng.sample(passages, 3), [])) for _ in range(30)]
    return dict(enumerate(dict.fromkeys(t.lower() for t in texts)))


def linked(spark, texts: dict, parts: int = 3, **options) -> dict:
    frame = spark.createDataFrame([(k, t.encode()) for k, t in texts.items()], "node long, text binary").repartition(parts)
    links = copies.near_links(settle(frame, "test-texts"), **options).collect()
    sets = {k: plain_shingles(t) for k, t in texts.items()}
    for a, b in links:
        assert a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    return classes(list(texts), {(a, b) for a, b in links})


def test_links_connect_all_alike_texts(spark, monkeypatch):
    texts = group_texts()
    want = plain_groups(texts)
    assert len(set(want.values())) < len(texts) - 40
    assert linked(spark, texts) == want
    assert linked(spark, texts, 7, map_bits=13) == want  # a full map of shingles that occur twice
    assert linked(spark, texts, 1, most_common=0) == want  # no order of common shingles at all
    raw = [t.encode() for t in texts.values()]
    whole = copies.shingle_sets(raw)
    assert list(map(len, whole)) == [len(plain_shingles(t)) for t in texts.values()]
    monkeypatch.setattr(copies, "AT_ONCE", 500)
    assert all((a == b).all() for a, b in zip(whole, copies.shingle_sets(raw), strict=True))


def test_links_equal_exact_sets_on_the_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    texts = dict(enumerate(dict.fromkeys(" ".join((r["text"] or "").encode().lower().decode().split()) for r in rows)))
    texts = {k: t for k, t in texts.items() if plain_shingles(t)}
    assert linked(spark, texts) == plain_groups(texts)


def test_an_unlike_common_passage_makes_few_pairs(spark):
    rng = random.Random(5)
    passage = prose(rng, 60)
    texts = {k: f"{prose(rng, 6)} {passage} {prose(rng, 6)}" for k in range(400)}
    frame = settle(spark.createDataFrame([(k, t.encode()) for k, t in texts.items()], "node long, text binary"), "test-texts")
    order = copies.Order(settle(copies.shingle_ranges(frame), "test-counts"), copies.MOST_COMMON)
    entries = copies.prefixes(frame, order).collect()
    assert sum(r["most"] >= r["n"] for r in entries) < len(texts) / 4
    assert copies.near_links(frame).count() == 0


def test_sketches_differ_no_more_than_their_sets():
    rng = np.random.default_rng(4)
    for n in (0, 1, 7, 90, 2000):
        one, other = (np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for _ in range(2))
        for k in {0, n // 9, n // 2, n}:
            both = np.union1d(one[k:], other[:k])
            apart = sum(int(x).bit_count() for x in (copies.sketch(one) ^ copies.sketch(both)).view(np.uint64))
            assert apart <= len(np.setxor1d(one, both))
            assert apart > 0 or k == 0


def test_edits_below_the_similarity_make_few_pairs(spark, monkeypatch):
    rng, judged, asked = random.Random(12), copies.judged, []
    monkeypatch.setattr(copies, "judged", lambda pairs, texts: asked.append(pairs.count()) or judged(pairs, texts))
    base, texts = prose(rng, 100).split(), {}
    for i in range(80):
        words = list(base)
        for k in rng.sample(range(5, 95, 6), 2):
            words[k] = f"edit{i}x{k}"
        texts[i] = " ".join(words)
    assert linked(spark, texts) == plain_groups(texts)
    assert sum(asked) <= 2 * len(texts)  # 3,160 pairs share shingles, sizes and places


def test_groups_grow_past_a_turn_that_connects_nothing(spark, monkeypatch):
    rng, judged, asked = random.Random(14), copies.judged, []
    monkeypatch.setattr(copies, "judged", lambda pairs, texts: asked.append(pairs.count()) or judged(pairs, texts))
    base = prose(rng, 150).split()
    texts = {1000: " ".join(base[:77]), 1001: " ".join(base[73:])}  # smallest at every shingle, and like no other text
    for i in range(120):
        words = list(base)
        words[rng.randrange(5, 145)] = f"edit{i}"
        texts[i] = " ".join(words)
    assert linked(spark, texts) == plain_groups(texts)
    assert sum(asked) <= 20 * len(texts)  # 7,140 pairs are alike


def test_classes_of_fingerprints_are_links_as_well(spark):
    rng = random.Random(13)
    cycle, words = "the copper ferry left harbour " * 30, prose(rng, 150).split()
    edited = words[:40] + ["otherwise", "said"] + words[42:]
    texts = {1: cycle + prose(rng, 12), 2: cycle + prose(rng, 12), 3: " ".join(words), 4: " ".join(edited), 5: prose(rng, 80)}
    bits = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert (bits[1] ^ bits[2]).bit_count() <= 2 < (bits[3] ^ bits[4]).bit_count()
    assert plain_groups(texts) == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in copies.one_of_each(docs, by_fingerprint=True).collect()) == [1, 3, 5]
    assert sorted(r["doc_id"] for r in copies.one_of_each(docs).collect()) == [1, 2, 3, 5]
    # A link through a text that goes: 1 and 2 by fingerprint, 2 and 6 by similarity.
    more = docs.union(spark.createDataFrame([(6, texts[2] + " " + "more")], docs.schema))
    assert sorted(r["doc_id"] for r in copies.one_of_each(more, by_fingerprint=True).collect()) == [1, 3, 5]


def test_rows_that_share_an_id_are_rows_of_their_own(spark):
    rng = random.Random(4)
    one, two = prose(rng, 40), prose(rng, 40)
    rows = [(5, one, "a"), (5, two, "b"), (5, two, "b"), (3, two, "a"), (7, one, "a"), (9, two + " end", "a"), (1, "", "x"), (0, None, "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, node string")
    left = sorted(tuple(r) for r in copies.one_of_each(frame.repartition(4)).fillna("").collect())
    assert left == [(0, "", "y"), (3, two, "a"), (5, one, "a")]
    again = [(5, one, "a")] * 30 + [(5, one, "b")] * 30
    assert copies.one_of_each(spark.createDataFrame(again, "doc_id long, text string, row string")).count() == 1


def test_near_copies_edges(spark):
    docs = edge_frame(spark)
    kept = copies.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(None) == 1 and ids.count(10) == 1 and ids.count(11) == 2 and 1 not in ids and 8 not in ids and 0 in ids
    assert copies.one_of_each(no_rows(spark)).count() == 0
