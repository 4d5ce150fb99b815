"""Personal data: base patterns, and a skip-chain conditional random field that adds to them.

Nodes are the pieces of a text that hold a digit or ``@``; all other words are observed context.
Chain edges join neighbours, skip edges join a piece to its next repetition anywhere in the document,
so that what is certain in one place decides the same piece elsewhere. Labels are inferred for a
document's whole graph by loopy message passing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.rows import ship, small_batches

KINDS = ("email", "ip", "card", "phone")
#: Base patterns (fixed); (?<!...) and possessive repeats only spare the search work.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")

SIGN = re.compile(r"[0-9@]")
BLANK = re.compile(r"\s")
PIECE = re.compile(r"[A-Za-z0-9._%+@()-]+")
EDGE_LEFT, EDGE_RIGHT = "._%-)@", "._%+@(-"

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def is_card(digits: str) -> bool:
    return 14 <= len(digits) <= 19 and luhn(digits)


def is_ip(text: str) -> bool:
    return all(len(x) <= 3 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in text.split(".")))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern in linear time: from each ``@`` both ways."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        elif start < at:
            free = at + 1
        at = text.find("@", max(free, at + 1))


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the base patterns, sorted by start, then kind."""
    out: list[Span] = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if SIGN.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if is_ip(m.group())]
        out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if is_card(NOT_DIGIT.sub("", m.group()))]
        if "+" in text:
            out += [
                (m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(NOT_DIGIT.sub("", m.group())) <= 15
            ]
    return sorted(out)


GROUP = re.compile(r"[0-9]+")
GROUPED = re.compile(r"[0-9]{4,}(?:[\x20-][0-9]+)+")


def grouped_cards(text: str) -> list[tuple[int, int]]:
    """Cards in groups, also beside other numbers: each run of groups is cut where most digits are in cards.

    All groups of a card but the last have at least four digits.
    """
    out: list[tuple[int, int]] = []
    for run in CARD.finditer(text):
        groups = [m.span() for m in GROUP.finditer(text, *run.span())] if run.end() - run.start() > 14 else []
        if len(groups) < 2:
            continue
        #: (digits covered, cards, first group of the last card or -1) by groups passed.
        best: list[tuple[int, int, int]] = [(0, 0, -1)]
        for j in range(len(groups)):
            found, digits = (*best[j][:2], -1), ""
            for i in range(j, -1, -1):
                a, b = groups[i]
                if (i < j and b - a < 4) or b - a + len(digits) > 19:
                    break
                digits = text[a:b] + digits
                if (i == j or b - a >= 4) and is_card(digits):
                    found = max(found, (best[i][0] + len(digits), best[i][1] + 1, i))
            best.append(found)
        own, j = [], len(groups)
        while j:
            i = best[j][2]
            if 0 <= i < j - 1:
                own.append((groups[i][0], groups[j - 1][1]))
            j = i if i >= 0 else j - 1
        out += own[::-1]
    return out


def pieces(text: str) -> list[tuple[int, int]]:
    """The nodes: runs of address and number characters, trimmed, with a digit or ``@``; a card in groups is one."""
    cards = grouped_cards(text)
    if not cards:
        return _words(text)
    out, k = [], 0
    for a, b in _words(text):
        while k < len(cards) and cards[k][1] <= a:
            out.append(cards[k])
            k += 1
        i = k
        while i < len(cards) and cards[i][0] < b:  # what is left of a word outside its cards
            out += _trimmed(text, a, cards[i][0])
            a = max(a, cards[i][1])
            if a > b:
                break
            out.append(cards[i])
            i += 1
            k = i
        out += _trimmed(text, a, b)
    return out + cards[k:]


def _trimmed(text: str, a: int, b: int) -> list[tuple[int, int]]:
    while a < b and text[a] in EDGE_LEFT:
        a += 1
    while a < b and text[b - 1] in EDGE_RIGHT:
        b -= 1
    return [(a, b)] if SIGN.search(text, a, b) else []


def _words(text: str) -> list[tuple[int, int]]:
    out = []
    found = SIGN.search(text)
    while found:
        start = found.start()
        while start and not text[start - 1].isspace():
            start -= 1
        blank = BLANK.search(text, found.end())
        end = blank.start() if blank else len(text)
        for m in PIECE.finditer(text, start, end):
            if SIGN.search(m.group()):
                out += _trimmed(text, *m.span())
        found = SIGN.search(text, end)
    return out


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
PHONE_TAIL = re.compile(r"\(?[0-9]{2,4}\)?(?:[.-]?[0-9]{2,4})*")
FEATURES = (
    "always email at quad digits letters plus brackets hyphen dots luhn "
    "size_1 size_4 size_7 size_10 size_14 size_20 after_plus after_brackets near_next near_previous tail"
).split()
NODE_BYTES = 64
#: Features of a piece that would be a base span if it stood by itself.
ALONE = sum(1 << FEATURES.index(x) for x in ("email", "quad", "luhn"))


def features(text: str, nodes: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """A bit set of :data:`FEATURES` per node, and whether only a blank parts it from the one before."""
    bits, near = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), bool)
    before, last = "", -9
    for i, (a, b) in enumerate(nodes):
        t = text[a : min(b, a + NODE_BYTES)]
        digits = NOT_DIGIT.sub("", t)
        if GROUPED.fullmatch(t) and is_card(digits):
            t = digits
        joined = a - last <= 1
        size = len(digits)
        flags = (
            True, "@" in t and bool(EMAIL.fullmatch(text, a, b)), "@" in t,
            bool(QUAD.fullmatch(t)) and is_ip(t), t.isdigit(), any(c.isalpha() for c in t), t[0] == "+",
            "(" in t, "-" in t, t.count(".") >= 3, size == len(t) and is_card(digits),
            1 <= size <= 3, 4 <= size <= 6, 7 <= size <= 9, 10 <= size <= 13, 14 <= size <= 19, size >= 20,
            joined and before[:1] == "+", joined and before[:1] == "(",
            i + 1 < len(nodes) and nodes[i + 1][0] - b <= 1, joined, bool(PHONE_TAIL.fullmatch(t)),
        )
        bits[i] = sum(1 << k for k, f in enumerate(flags) if f)
        near[i] = joined
        before, last = t, b
    return bits, near


def repeats(text: str, nodes: list[tuple[int, int]]) -> np.ndarray:
    """For each node the one before with the same letters and digits, -1 without: m repetitions of a
    piece make m - 1 edges. Pieces of fewer than four such characters say too little."""
    seen: dict[str, int] = {}
    out = np.full(len(nodes), -1, np.int64)
    for i, (a, b) in enumerate(nodes):
        form = "".join(c for c in text[a:b].lower() if c.isalnum() or c == "@")
        if len(form) >= 4:
            out[i] = seen.get(form, -1)
            seen[form] = i
    return out


def labels(nodes: list[tuple[int, int]], spans: list[Span]) -> np.ndarray:
    """1 + kind of the base span that covers a node, 0 without; spans are sorted by start."""
    out = np.zeros(len(nodes), np.int64)
    for kind in range(len(KINDS)):
        own = [(a, b) for a, k, b in spans if k == kind]
        if own:
            starts = np.array([a for a, _ in own])
            at = np.searchsorted(starts, [a for a, _ in nodes], side="right") - 1
            for i, k in enumerate(at):
                if k >= 0 and nodes[i][1] <= own[k][1] and not out[i]:
                    out[i] = 1 + kind
    return out


@dataclass(frozen=True)
class Field:
    """Potentials: features by label, chain and skip tables of label by label."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, bits: np.ndarray, near: np.ndarray, same: np.ndarray, rounds: int = 12) -> np.ndarray:
        """Beliefs by loopy message passing in log space, all nodes of a batch at once."""
        onehot = (bits[:, None] >> np.arange(len(FEATURES))) & 1
        own = onehot @ self.unary
        i = np.flatnonzero(near)
        j = np.flatnonzero(same >= 0)
        a, b = np.concatenate([i - 1, same[j]]), np.concatenate([i, j])
        if not len(a):
            return _softmax(own)
        table = np.concatenate([np.repeat(self.chain[None], len(i), 0), np.repeat(self.skip[None], len(j), 0)])
        right, left = np.zeros((len(a), own.shape[1])), np.zeros((len(a), own.shape[1]))
        for _ in range(rounds):
            total = own.copy()
            np.add.at(total, b, right)
            np.add.at(total, a, left)
            to_right = _log_sum((total[a] - left)[:, :, None] + table, 1)
            to_left = _log_sum((total[b] - right)[:, None, :] + table, 2)
            new_right = to_right - to_right.max(axis=1, keepdims=True)
            new_left = to_left - to_left.max(axis=1, keepdims=True)
            moved = max(np.abs(new_right - right).max(), np.abs(new_left - left).max())
            right, left = (right + new_right) / 2, (left + new_left) / 2
            if moved < 1e-3:
                break
        total = own.copy()
        np.add.at(total, b, right)
        np.add.at(total, a, left)
        return _softmax(total)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in small_batches(batches):
        yield batch, [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]


def fit(docs: DataFrame, text: str = "text", rounds: int = 300) -> Field:
    """Potentials learned from the base patterns' own labels in all documents.

    What learning needs is counted in the tasks and added up: how often each set of features has each
    label, and each pair of labels along chain and skip edges; a few thousand rows whatever the input.
    A piece that its neighbours alone keep from being a base span teaches nothing: it is what the
    method is to decide.
    The parts are fitted one by one: features by regression, tables as how much more often a pair
    occurs than by chance. Without any node the field says nothing.
    """
    ship(docs.sparkSession)
    n = len(KINDS) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int, int], int] = {}
        for _, content in _texts(batches):
            for t in content:
                nodes = pieces(t)
                if not nodes:
                    continue
                bits, near = features(t, nodes)
                same, own = repeats(t, nodes), labels(nodes, base_spans(t))
                clear = (own > 0) | (bits & ALONE == 0)
                i, j = np.flatnonzero(near), np.flatnonzero(same >= 0)
                i, j = i[clear[i] & clear[i - 1]], j[clear[j] & clear[same[j]]]
                for part, x, y in (("unary", bits[clear], own[clear]), ("chain", own[i - 1], own[i]), ("skip", own[same[j]], own[j])):
                    for pair in zip(x.tolist(), y.tolist()):
                        seen[(part, *pair)] = seen.get((part, *pair), 0) + 1
        if seen:
            parts, xs, ys = zip(*seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts), pa.array(xs, pa.int64()), pa.array(ys, pa.int64()), pa.array(list(seen.values()), pa.int64())],
                ["part", "x", "y", "c"],
            )

    table = docs.select(F.col(text).alias("text")).mapInArrow(count, "part string, x long, y long, c long")
    rows = table.groupBy("part", "x", "y").agg(F.sum("c").alias("c")).collect()
    unary = [(r["x"], r["y"], r["c"]) for r in rows if r["part"] == "unary"]
    pairs = {"chain": np.full((n, n), 0.5), "skip": np.full((n, n), 0.5) + 4 * np.eye(n)}
    for r in rows:
        if r["part"] != "unary":
            pairs[r["part"]][r["x"], r["y"]] += r["c"]
    tables = {}
    for part, c in pairs.items():
        share = c / c.sum()
        ratio = np.log(share) - np.log(share.sum(axis=1, keepdims=True)) - np.log(share.sum(axis=0, keepdims=True))
        tables[part] = np.clip(ratio, -3, 3)
    weights = np.zeros((len(FEATURES), n))
    if unary:
        x, y, c = (np.array(v) for v in zip(*sorted(unary)))
        onehot = ((x[:, None] >> np.arange(len(FEATURES))) & 1).astype(float)
        target = np.eye(n)[y]
        mass = np.sqrt(c) / np.sqrt(c).sum()
        speed = np.zeros_like(weights)
        for _ in range(rounds):
            slope = onehot.T @ ((_softmax(onehot @ weights) - target) * mass[:, None]) + 1e-4 * weights
            speed = 0.9 * speed - 0.5 * slope
            weights = weights + speed
    return Field(weights, tables["chain"], tables["skip"])


def added_spans(text: str, nodes: list[tuple[int, int]], chance: np.ndarray, base: list[Span], least: float = 0.9) -> list[Span]:
    """Nodes whose likeliest label is a kind, with at least that chance, outside all base spans.

    Neighbouring phone pieces make a run, which is cut into spans that have as many digits as a phone.
    Cards in groups are single nodes, see :func:`pieces`.
    """
    best = chance.argmax(axis=1)
    taken = sorted((a, b) for a, _, b in base)
    runs: list[tuple[int, list[tuple[int, int]]]] = []
    i = 0
    for k, (a, b) in enumerate(nodes):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if not best[k] or chance[k, best[k]] < least or (i < len(taken) and taken[i][0] < b):
            continue
        kind = int(best[k]) - 1
        if runs and kind == 3 and runs[-1][0] == 3 and a - runs[-1][1][-1][1] <= 1 and text[a] != "+":
            runs[-1][1].append((a, b))
        else:
            runs.append((kind, [(a, b)]))
    return [s for kind, run in runs for s in _cut(text, kind, run)]


def _cut(text: str, kind: int, run: list[tuple[int, int]]) -> list[Span]:
    """The plausible spans of consecutive pieces of a run that cover most digits, of these the most spans."""
    if len(run) == 1:
        return [(a, kind, b) for a, b in run if _plausible(text[a:b], kind)]
    least, most = DIGITS[kind]
    counts = [len(NOT_DIGIT.sub("", text[a:b])) for a, b in run]
    #: (digits covered, spans, first piece of the last span or -1) by pieces passed.
    best: list[tuple[int, int, int]] = [(0, 0, -1)]
    for j in range(len(run)):
        found, digits = (*best[j][:2], -1), 0
        for i in range(j, max(-1, j - most), -1):
            digits += counts[i]
            if digits > most:
                break
            if digits >= least:
                found = max(found, (best[i][0] + digits, best[i][1] + 1, i))
        best.append(found)
    out: list[Span] = []
    j = len(run)
    while j:
        i = best[j][2]
        if i >= 0:
            out.append((run[i][0], kind, run[j - 1][1]))
        j = i if i >= 0 else j - 1
    return out[::-1]


DIGITS = {2: (14, 19), 3: (10, 15)}


def _plausible(t: str, kind: int) -> bool:
    if kind == 0:
        return "@" in t
    if kind == 1:
        return t.count(".") == 3
    return DIGITS[kind][0] <= len(NOT_DIGIT.sub("", t)) <= DIGITS[kind][1]


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span (overlapping ones together) replaced by its kind in brackets."""
    out, end = [], 0
    for a, kind, b in spans:
        if a >= end:
            out += [text[end:a], f"[{KINDS[kind].upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def _found(texts: list[str], model: Field) -> list[tuple[list[Span], list[Span]]]:
    """(base, all) spans of each text; the graphs of a batch are passed over together."""
    base = [base_spans(t) for t in texts]
    nodes = [pieces(t) for t in texts]
    at = [i for i, x in enumerate(nodes) if x]
    parts, start = [], 0
    for i in at:
        bits, near = features(texts[i], nodes[i])
        same = repeats(texts[i], nodes[i])
        parts.append((bits, near, np.where(same >= 0, same + start, -1)))
        start += len(nodes[i])
    every = list(base)
    if parts:
        chance = model.marginals(*(np.concatenate(x) for x in zip(*parts)))
        start = 0
        for i in at:
            own = chance[start : start + len(nodes[i])]
            start += len(nodes[i])
            every[i] = sorted(base[i] + added_spans(texts[i], nodes[i], own, base[i]))
    return list(zip(base, every))


DIGEST = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find_personal(docs: DataFrame, model: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for every row.

    Counts and digest are those of the base spans; ``spans`` has all. Positions are code points, ends
    exclusive. Null and empty texts have none. Repeated rows get equal results; other columns are not
    read. A document's graph stays in its task: its size is that of the text.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, content in _texts(batches):
            rows = []
            for base, every in _found(content, shared.value):
                counts = [sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(every), len(every) - len(base)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [x.split()[0] for x in DIGEST.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, DIGEST)


def mask_personal(docs: DataFrame, model: Field, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The documents with all spans masked in ``text`` and its new length in ``n_chars``; null stays null."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema, place = docs.schema, docs.columns.index(text)
    sized = docs.columns.index(n_chars) if n_chars in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            content = batch.column(place).to_pylist()
            found = _found([t or "" for t in content], shared.value)
            new = [None if t is None else masked(t, every) for t, (_, every) in zip(content, found)]
            columns = list(batch.columns)
            columns[place] = pa.array(new, batch.schema.field(place).type)
            if sized is not None:
                lengths = pa.array([None if t is None else len(t) for t in new], pa.int64())
                columns[sized] = lengths.cast(batch.schema.field(sized).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, schema)
