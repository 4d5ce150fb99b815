"""Alignment of two tokenizers against whole-text encoding and plain enumeration."""

from __future__ import annotations

import bisect
import hashlib
import random
from collections import Counter, defaultdict
from itertools import accumulate

import public_tokenizers
import pytest
import sentencepiece
from tallywright.llm import alignment
from tests.llm.cases import edge_frame, edge_rows, no_rows, prose
from tokenizers import Tokenizer

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    chars = alignment.byte_alphabet()
    vocabulary = {v: k for k, v in a.get_vocab().items()}

    def groups(text: str | None) -> list[tuple[list[int], list[int]]]:
        """Groups by whole-text encoding and sets of ends."""
        if not text:
            return []
        left = a.encode(" " + text, add_special_tokens=False).ids
        right = b.encode(text)
        raw_a = [bytes(chars[c] for c in vocabulary[x]) for x in left]
        raw_b = [
            bytes([int(b.id_to_piece(y)[3:5], 16)]) if b.is_byte(y) else b.id_to_piece(y).replace("▁", " ").encode()
            for y in right
        ]
        whole = (" " + text).encode()
        if b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            return []
        ends_a, ends_b = list(accumulate(map(len, raw_a))), list(accumulate(map(len, raw_b)))
        cuts = sorted(set(ends_a) & set(ends_b))
        out = [([], []) for _ in cuts]
        for side, ids, ends in ((0, left, ends_a), (1, right, ends_b)):
            for token, end in zip(ids, ends):
                out[bisect.bisect_left(cuts, end)][side].append(token)
        return out

    return groups


def expected(rows, plain):
    every = [(doc, plain(text)) for doc, text in rows]
    count = Counter()
    for _, groups in every:
        count.update({(x, y) for left, right in groups for x in left for y in right})
    top = defaultdict(int)
    for (x, _), c in count.items():
        top[x] = max(top[x], c)
    out = []
    for doc, groups in every:
        n_links = n_best = total = 0
        for left, right in groups:
            for (x, m) in Counter(left).items():
                for (y, n) in Counter(right).items():
                    n_links += m * n
                    n_best += m * n * (count[x, y] == top[x])
                    total += m * n * count[x, y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            -1 if doc is None else doc, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), n_links,
            n_best, total, hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return sorted(out)


def texts() -> list[tuple]:
    rng = random.Random(9)
    odd = [
        "  two spaces  inside ", " lead", "trail ", "tab\there", "a\n\nb \n c", "<|endoftext|> and <s> </s> <unk> <0x41>",
        "it's 'quoted' don't 12 345,6", "▁under", "ends in ▁", "　wide 　 space  nb  x", "x  y",
        "日本語の 文章です。 漢字", "Привет мир ёлка", "naïve  é é ﬁ", "a\x00b c", "😀 😀😀 emoji", "x" * 5000, "ab" * 3000,
        "año ñandú él \u0085next", "€ 5 — dash – “q”", "à" * 700, "\r\n \r\n", " ", "   ", "a" * 63 + " " + "b" * 200,
    ]
    rows = [(k, t) for k, t in enumerate(odd)]
    rows += [(100 + k, prose(rng, rng.randint(1, 60), "aeinrstñé ,.")) for k in range(60)]
    rows += [(200 + k, "the same text many times") for k in range(50)]
    rows += [(300, None), (301, ""), (300, None), (None, "no id"), (302, "same id"), (302, "same id"), (302, "other text")]
    return rows


def test_measures_equal_whole_text_encoding(spark, plain, monkeypatch):
    rows = texts()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = expected(rows, plain)

    def got(frame, **options):
        found = alignment.align_tokenizers(frame, A, B, **options)
        return sorted(tuple(r) for r in found.na.fill(-1, ["doc_id"]).collect())

    assert got(frame) == want
    assert got(frame, most=50) == want  # many slices of pairs
    monkeypatch.setattr(alignment, "COPIES_A_TASK", 7)  # copies dealt over tasks
    assert got(frame) == want


def test_edge_rows_and_real_documents(spark, plain, sf):
    rows = [(r[0], r[1]) for r in edge_rows()]
    found = alignment.align_tokenizers(edge_frame(spark), A, B).na.fill(-1, ["doc_id"])
    assert sorted(tuple(r) for r in found.collect()) == expected(rows, plain)
    assert alignment.align_tokenizers(no_rows(spark), A, B).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = alignment.align_tokenizers(docs, A, B).collect()
    assert sorted(tuple(r) for r in found) == expected(rows, plain)


def test_groups_as_text_and_forgetting(spark, plain, monkeypatch):
    monkeypatch.setattr(alignment, "MOST_PARTS", 3)
    monkeypatch.setattr(alignment, "SEGMENT", 40)
    monkeypatch.setattr(alignment, "JOINED", 30)
    monkeypatch.setattr(alignment, "LARGE_GROUP", 2)
    both = alignment.Aligner(A, B)
    every = [None if t is None else t.encode() for _, t in texts()]
    for found in ([both.align([t])[0] for t in every], both.align(every)):
        for (_, text), (sizes, groups, codes, times) in zip(texts(), found):
            want = plain(text)
            assert (groups is None) == (not want)
            pairs = Counter()
            for x, y in want:
                for p, m in Counter(x).items():
                    for q, n in Counter(y).items():
                        pairs[p * both.n_b + q] += m * n
            assert dict(zip(codes.tolist(), times.tolist())) == pairs
            assert sizes == [*(sum(len(g[k]) for g in want) for k in (0, 1)), len(want), sum(pairs.values())]
            if want:
                assert groups.decode() == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in want)
    frame = spark.createDataFrame([("a b", 1)], "text string, copies long")
    row = alignment.aligned_texts(frame, A, B, keep_groups=True).first()
    assert hashlib.sha256(row["groups"].encode()).hexdigest() == row["groups_sha256"]
