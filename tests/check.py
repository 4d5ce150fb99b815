"""``python tests/check.py SF_DIR [name ...]``: compare queries with their SQL twins."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from tallywright.session import local_session  # noqa: E402
from tests.compare import difference, duck  # noqa: E402


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), duck(sf_dir)
    sql, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            if name in sql:
                problem = difference(fn(spark, sf_dir), con, sql[name])
                note = "ok" if problem is None else "DIFF " + problem
            else:
                note = f"rows {fn(spark, sf_dir).count()}"
                problem = None
        except Exception as e:  # report and go on
            problem = note = f"ERROR {type(e).__name__} {str(e)[:700]}"
        bad += problem is not None
        if problem is not None or names:
            print(f"{name}: {note}", flush=True)
        else:
            print(f"{name}: {note} {time.time() - t:.1f}s", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
