"""Run a query next to its SQL twin and report differences."""

from __future__ import annotations

import math

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in data)


def difference(df, con, sql: str) -> str | None:
    """None when column names, row count and all values agree."""
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    a, b = rows(got_cols, got), rows(want_cols, want)
    if len(a) != len(b):
        return f"row count {len(a)} != {len(b)}; e.g. {a[:2]} / {b[:2]}"
    for x, y in zip(a, b):
        if x != y:
            bad = sum(1 for p, q in zip(a, b) if p != q)
            return f"{bad} of {len(a)} rows differ ({sorted(got_cols)}); {x} != {y}"
    return None
