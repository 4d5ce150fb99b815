"""Quality rules, URL filter, language identification and personal data."""

from __future__ import annotations

import hashlib
import random
import re
import time

import numpy as np
import pytest
from tallywright.llm import language, privacy, quality, urls
from tests.llm.cases import edge_frame, edge_rows, no_rows, prose


def quality_counts(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows: dict[tuple, list[int]] = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_quality_counts_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [r[1] for r in edge_rows()]
    for _ in range(40):
        part = [prose(rng, 12, "ab#|é") for _ in range(3)]
        texts.append("\n".join(rng.choice(part) for _ in range(rng.randint(1, 9))) + rng.choice(["", "\x0b\x0cx", "\r\n"]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in quality.score_quality(df).collect():
        want = quality_counts(texts[row["doc_id"]])
        got = tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert got == want, texts[row["doc_id"]]
        assert row["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (row["base_failed"] and row["kept"])


def test_quality_keeps_own_columns_and_clean_documents(spark):
    docs = edge_frame(spark)
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns
    scored = quality.score_quality(docs)
    assert scored.count() == docs.count() and scored.columns.count("kept") == 1
    assert quality.score_quality(no_rows(spark)).count() == 0
    clean = "The quick fox and the lazy dog met in a field that lay to the north of town, " * 1
    text = clean + " ".join(f"word{i} of the day" for i in range(30))
    row = quality.score_quality(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["kept"] and row["broken"] == []


def test_quality_plan_is_one_projection(spark):
    plan = quality.score_quality(edge_frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_url_parts_and_rules(spark):
    cases = [
        ("http://Blog.Example.NET/en/x?y#z", "blog.example.net", "/en/x", "example.net/en/"),
        ("https://a.net", "a.net", "", None), ("https://a.net/", "a.net", "/", "net/"),
        ("x://internet/a", "internet", "/a", None), ("http://example.com/de/1", "example.com", "/de/1", "example.com/de/"),
        ("http://w.org/fr/", "w.org", "/fr/", "org/fr/"), ("nothing", "", "", None), (None, "", "", None),
        ("", "", "", None), ("http://h?q=/a://b", "h", "", None), ("http://\u00c9A.org/\nfr", "\u00c9a.org", "/\nfr", None),
    ]
    df = spark.createDataFrame([(i, c[0], "h") for i, c in enumerate(cases)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in urls.judge_urls(df).collect()}
    for i, (_, host, path, rule) in enumerate(cases):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] in ("allow", "block")
        if rule:
            assert got[i]["verdict"] == ("allow" if rule in ("example.net/en/", "org/fr/") else "block")
    assert urls.judge_urls(df.filter("false")).count() == 0


def test_url_models_part_two_styles(spark):
    rows, rng = [], random.Random(2)
    for i in range(300):
        word = "".join(rng.choice("aeiou" if i % 2 else "xzqkw") for _ in range(8))
        rows.append((i, f"http://{word}.{'org/fr' if i % 2 else 'net'}/{word}", i % 2))
    for i in range(300, 340):
        word = "".join(rng.choice("aeiou" if i % 2 else "xzqkw") for _ in range(8))
        rows.append((i, f"http://{word}.info/{word}", i % 2))
    df = spark.createDataFrame(rows + rows[-1:] * 3, "page_id long, url string, good int")
    judged = urls.judge_urls(df).filter("rule is null").collect()
    assert len(judged) == 43
    assert sum((r["verdict"] == "allow") == (r["good"] == 1) for r in judged) >= 40


LETTERS = {"en": "abcdet", "de": "fgheik", "fr": "lmnope", "xx": "qrstuv"}


def language_rows() -> list[tuple]:
    rng = random.Random(3)
    return [(i, prose(rng, rng.randint(5, 60), LETTERS[g]), g) for i, g in enumerate(list(LETTERS) * 50)]


def test_language_held_out_accuracy(spark):
    df = spark.createDataFrame(language_rows(), "doc_id long, text string, lang string")
    model = language.fit(df)
    found = language.predict(df, model).filter("held_out").join(df.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) > 20 and all(r["lang"] == r["lang_pred"] and 0 <= r["score"] <= 1 for r in found)


def test_language_learns_nothing_from_held_out_rows(spark):
    df = spark.createDataFrame(language_rows(), "doc_id long, text string, lang string")
    other = df.withColumn("lang", language.F.when(language.held_out(language.F.col("doc_id")), "zz").otherwise(df["lang"]))
    assert language.fit(other).langs == sorted(LETTERS)


def test_language_edges(spark):
    model = language.fit(edge_frame(spark))
    found = language.predict(edge_frame(spark), model).collect()
    assert len(found) == len(edge_rows())
    by_id = {r["doc_id"]: r for r in found}
    assert all(by_id[k]["lang_pred"] == "und" and by_id[k]["score"] == 0 for k in (0, 1, 2, 10))
    empty = language.fit(no_rows(spark))
    assert {r["lang_pred"] for r in language.predict(edge_frame(spark), empty).collect()} == {"und"}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 12])
def test_codewords_differ(n):
    code = language.codewords(n)
    assert code.shape[0] == n and len({tuple(r) for r in code.tolist()}) == n
    if 3 <= n <= 7:
        least = min(int((code[a] != code[b]).sum()) for a in range(n) for b in range(a))
        assert least == 2 ** (n - 2)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t: str) -> list[tuple]:
    def digits(m):
        return re.sub("[^0-9]", "", m.group())

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0

    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return sorted(out + [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(digits(m)) <= 15])


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(5)
    for _ in range(15_000):
        t = "".join(rng.choice("ab1234567890@.+-() é_% \n") for _ in range(rng.randint(0, 60)))
        assert privacy.base_spans(t) == plain_spans(t)


def test_base_spans_of_long_runs_are_linear():
    for t in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1" + "(" * 400_000, "@" * 400_000, "a@" * 200_000):
        start = time.perf_counter()
        found = privacy.base_spans(t)
        assert time.perf_counter() - start < 10
        assert found == [] or t.startswith("1.")


def personal_docs(spark):
    rng = random.Random(6)
    rows = []
    for i in range(200):
        card = ["4111111111111111", "5500005555555559", "340000000000009"][i % 3]
        rows.append((i, f"{prose(rng, 9)} {card} {prose(rng, 5)} me{i}@mail.org {prose(rng, 4)} +1 (743) 555-38{i % 90 + 10} at 10.1.2.{i}"))
    hidden = f"{prose(rng, 5)} 4111111111111111 5500005555555559 {prose(rng, 6)} 4111111111111111 {prose(rng, 3)}"
    return spark.createDataFrame([*rows, (900, hidden), (901, prose(rng, 50)), (902, "Version 2.0, 12 of 345678901 in 1999")], "doc_id long, text string")


def test_field_adds_what_neighbours_hide_and_nothing_else(spark):
    docs = personal_docs(spark)
    found = {r["doc_id"]: r for r in privacy.find_personal(docs, privacy.fit(docs)).collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i, row in found.items():
        base = plain_spans(text[i])
        assert row["base_sha256"] == hashlib.sha256(privacy.written(base).encode()).hexdigest()
        assert set(privacy.written(base).split(",")) <= set(row["spans"].split(","))
    first = text[900].index("4111")
    assert f"card:{first}:{first + 16}" in found[900]["spans"] and f"card:{first + 17}:{first + 33}" in found[900]["spans"]
    assert found[901]["spans"] == "" and found[902]["spans"] == ""


def test_masking_keeps_rows_and_columns(spark):
    docs = edge_frame(spark)
    masked = privacy.mask_personal(docs, privacy.fit(docs))
    assert masked.columns == docs.columns and masked.count() == docs.count()
    rows = masked.filter("doc_id = 11").orderBy("text").collect()
    assert rows[0]["text"] == "[EMAIL] [PHONE]" and rows[0]["n_chars"] == 15
    assert masked.filter("doc_id = 0").first()["text"] is None
    assert privacy.find_personal(no_rows(spark), privacy.fit(no_rows(spark))).count() == 0


CARDS = ["4111 1111 1111 1111", "5500 0000 0000 0004", "3400-0000-0000-009", "6011 0000 0000 0004"]


def grouped_docs(spark):
    rng = random.Random(7)
    rows = []
    for i in range(200):
        rows.append((i, f"{prose(rng, 9)} {CARDS[i % 4]} {prose(rng, 5)} me{i}@mail.org {prose(rng, 4)} +1 (743) 555-38{i % 90 + 10} at 10.1.2.{i}"))
    beside = [f"{CARDS[0]} {CARDS[1]}", f"{CARDS[0]} 12 26", f"{CARDS[1]} 123", f"{CARDS[3]} {CARDS[0]} {CARDS[1]}"]
    rows += [(900 + k, f"{prose(rng, 5)} {t} {prose(rng, 6)}") for k, t in enumerate(beside)]
    return spark.createDataFrame(rows, "doc_id long, text string"), beside


def test_cards_in_groups_beside_numbers_are_found(spark):
    docs, beside = grouped_docs(spark)
    model = privacy.fit(docs)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = {r["doc_id"]: r["spans"] for r in privacy.find_personal(docs, model).collect()}
    for k, t in enumerate(beside):
        assert not any(kind == 2 for _, kind, _ in plain_spans(text[900 + k]))
        for card in CARDS:
            if card in t:
                at = text[900 + k].index(card)
                assert f"card:{at}:{at + len(card)}" in found[900 + k].split(",")
    masked = {r["doc_id"]: r["text"] for r in privacy.mask_personal(docs, model).collect()}
    assert "[CARD] [CARD]" in masked[900] and "1111" not in masked[901] + masked[902] + masked[903]


def sure(text: str, kind: int) -> list[tuple]:
    nodes = privacy.pieces(text)
    chance = [[float(k == kind + 1) for k in range(5)] for _ in nodes]
    return [(text[a:b], k) for a, k, b in privacy.added_spans(text, nodes, np.array(chance).reshape(-1, 5), [])]


def test_runs_are_cut_by_digits_and_luhn():
    def cards(text):
        return [text[a:b] for a, b in privacy.grouped_cards(text)]

    assert cards(f"{CARDS[0]} {CARDS[1]}") == CARDS[:2] and cards(f"77 {CARDS[0]} 12 26") == [CARDS[0]]
    assert cards("4111 1111 1111 1112") == [] and cards("4111111111111111 5500005555555559") == []
    assert cards(f"{CARDS[2]} {CARDS[0]}-12") == [CARDS[2], CARDS[0]]
    text = f"a-{CARDS[2]}-12 {CARDS[0]} x"
    assert [text[a:b] for a, b in privacy.pieces(text)] == [CARDS[2], "12", CARDS[0]]
    assert sure("743 555 3824 212 555 1234", 3) == [("743 555 3824", 3), ("212 555 1234", 3)]
    assert sure("+1 (743) 555-3824", 3) == [("+1 (743) 555-3824", 3)] and sure("555 3824", 3) == []
    for text in (f"{CARDS[0]} " * 20_000, "1 " * 200_000, "1-" * 200_000, "1111 " * 80_000):
        start = time.perf_counter()
        assert len(privacy.pieces(text)) >= 1 and time.perf_counter() - start < 20
