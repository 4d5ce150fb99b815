"""Token ids, Huffman files, packing and mixing."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tallywright.llm import huffman, mixing, packing, tokens
from tallywright.workspace import settle, shared_dir
from tests.llm.cases import edge_frame, edge_rows, no_rows, prose

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    return tokens.WordEncoder(PATH, most_words=2_000)


def plain_ids(encoder, text: str | None) -> list[int]:
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_word_ids_equal_the_librarys(encoder, monkeypatch):
    rng = random.Random(1)
    alphabet = "ab.,' \n\t\x0b\x01\x1cÉé\u0301ΣA<|>'s1\x85 "
    texts = ["", None, "  ", "a.b. c", "It's. Don't, x", "\x01 a \x01\x01 b\x01", "<|endoftext|> A<|ENDOFTEXT|>b.", "ΑΣ ΑΣ. İ", "x" * 5_000 + " y"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    want = [plain_ids(encoder, t) for t in texts]
    assert [x.tolist() for x in encoder.encode(texts)] == want
    monkeypatch.setattr(tokens, "CHUNK", 64)
    assert [x.tolist() for x in encoder.encode(texts)] == want


@pytest.mark.parametrize("n", [1, 2, 3, 50, 3_000])
def test_code_lengths_are_optimal_and_limited(n):
    rng = np.random.default_rng(n)
    counts = np.sort((rng.pareto(0.5, n) * 10).astype(np.int64) + 1)
    limit = max(1, (n - 1).bit_length() + 1)
    lengths = huffman.code_lengths(counts, limit)
    assert lengths.max() <= limit and (n == 1 or (2.0**-lengths).sum() == 1)
    heap = sorted(counts.tolist())
    total = 0
    while len(heap) > 1:
        a, b = heap.pop(0), heap.pop(0)
        total += a + b
        heap = sorted([*heap, a + b]) if n <= 50 else heap
        if n > 50:
            break
    if 1 < n <= 50:
        assert (huffman.code_lengths(counts, 40) * counts).sum() == total


def test_codec_round_trip():
    rng = np.random.default_rng(2)
    ids = (rng.zipf(1.2, 50_000) % 5_000).astype(np.int64)
    values, counts = np.unique(ids, return_counts=True)
    codec = huffman.Codec(values, huffman.code_lengths(counts, 16))
    for n in (0, 1, 127, 128, 129, 50_000):
        data, marks = codec.encode(ids[:n])
        assert (codec.decode(data, n, marks) == ids[:n]).all()


def written(spark, docs):
    return settle(tokens.tokenise(docs, PATH, 1), "test-ids")


def test_files_give_back_every_id(spark, encoder):
    folder = shared_dir(spark, "test-files")
    huffman.write_ids(written(spark, edge_frame(spark)), folder, block_ids=3)
    got = sorted(huffman.read_ids(spark, folder, keep_ids=True).collect(), key=lambda r: r["start"])
    want = sorted((r[0] is not None, r[0] or 0) for r in edge_rows())
    assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got] == want
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    texts = defaultdict(list)
    for r in edge_rows():
        texts[r[0]].append(np.array([*plain_ids(encoder, r[1]), 1], "<u4").tobytes())
    for r in got:
        assert bytes(r["ids"]) in texts[r["doc_id"]] and r["ids_crc32"] == zlib.crc32(r["ids"]) and 4 * r["n_tokens"] == len(r["ids"])
    assert spark.read.parquet(f"{folder}/blocks").count() > 3


def test_files_of_no_rows(spark):
    folder = shared_dir(spark, "test-files")
    huffman.write_ids(written(spark, no_rows(spark)), folder)
    assert huffman.read_ids(spark, folder).count() == 0


def test_packing_covers_every_id_once(spark, encoder):
    rng = random.Random(3)
    extra = [(100 + i, prose(rng, rng.randint(1, 700)), "en", "a", 1, *edge_rows()[0][5:]) for i in range(60)]
    docs = spark.createDataFrame(edge_rows() + extra, edge_frame(spark).schema)
    rows = packing.pack(written(spark, docs), keep_ids=True, shard_ids=20_000).collect()
    sequences = defaultdict(list)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"] and r["length"] > 0
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2_048
    total = sum(r["length"] for r in rows)
    assert len(sequences) * 2_048 - total < 0.05 * total + 8 * 2_048
    whole = defaultdict(list)
    for r in edge_rows() + extra:
        if r[0] not in (10, 11):
            whole[r[0]] = [*plain_ids(encoder, r[1]), 1]
    for doc, ids in whole.items():
        own = sorted((r["start"], r["ids"]) for r in rows if r["doc_id"] == doc)
        assert b"".join(bytes(x) for _, x in own) == np.array(ids, "<u4").tobytes()
    assert packing.pack(written(spark, no_rows(spark))).count() == 0


def test_neighbours_share_rare_terms():
    ids = [np.array(x) for x in ([5, 1, 2, 3, 9], [6, 1, 2, 3, 8], [5, 7, 7, 7, 9], [4, 4, 4, 4, 4])]
    idf = np.array([0, 0.1, 0.1, 0.1, 1, 3, 3, 2, 2, 3.0])
    shard = packing.Shard([(i, 0, x, 5) for i, x in enumerate(ids)], idf, 5.0, 8)
    assert shard.neighbours(0).tolist()[:2] == [0, 2]
    windows = list(shard.windows())
    assert [p[0] for p in windows[0]] == [0, 2] and sum(len(p[2]) for w in windows for p in w) == 20


def plain_targets(sizes: dict, share: float = 1.5) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while True:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= set(over)


def mix_frame(spark):
    rng = random.Random(4)
    rows = edge_rows()
    for i in range(700):
        source = rng.choice(["hot"] * 9 + ["b", "c", None, "", "d", "é"])
        rows.append((1_000 + i, prose(rng, rng.randint(0, 90)), "en", source, 1, *rows[0][5:]))
    return spark.createDataFrame(rows + rows[-1:] * 5, edge_frame(spark).schema)


def test_mix_meets_its_targets(spark):
    docs = mix_frame(spark)
    got = mixing.taken_words(docs).collect()
    assert len(got) == docs.count()
    size = defaultdict(int)
    for r in docs.collect():
        size[r["source"]] += len((r["text"] or "").encode().split())
    want = plain_targets(size)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(want[r["source"]], abs=1e-6)
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)


def test_mix_agrees_however_rows_are_dealt(spark):
    docs = mix_frame(spark)
    again = mixing.taken_words(docs.repartition(7, "text"))
    one, two = ([tuple(r) for r in x.collect()] for x in (mixing.taken_words(docs), again))
    assert sorted(one, key=str) == sorted(two, key=str)


def test_mixed_documents_hold_the_taken_words(spark):
    docs = mix_frame(spark)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    taken, held = defaultdict(int), defaultdict(int)
    for r in mixing.taken_words(docs).collect():
        taken[r["doc_id"]] += r["taken"]
    for r in mixed.collect():
        held[r["doc_id"]] += len(r["text"].encode().split())
    assert {k: v for k, v in taken.items() if v} == dict(held)
    assert mixing.mixed_documents(no_rows(spark)).count() == 0 and mixing.taken_words(no_rows(spark)).count() == 0


def test_rounding_keeps_expectations(spark):
    """Over many seeds a document is taken as often as its source's share says."""
    docs = spark.createDataFrame([(i, "a " * n, "s") for i, n in enumerate([3, 5, 8, 20])] + [(9, "b " * 40, "t")], "doc_id long, text string, source string")
    sums = defaultdict(float)
    for seed in range(30):
        for r in mixing.taken_words(docs, share=1.25, seed=seed).collect():
            sums[r["doc_id"]] += r["taken"] / r["size"] / 30
    rate = {r["doc_id"]: r["target"] / r["source_size"] for r in mixing.taken_words(docs, share=1.25).collect()}
    assert all(abs(sums[d] - rate[d]) < 0.3 for d in rate)
