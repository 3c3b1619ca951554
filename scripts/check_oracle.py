"""Run queries and their SQL side by side.

``python scripts/check_oracle.py SF_DIR [--hot] [query ...]``: with ``--hot`` every key with more than
40 rows counts as hot and nothing is small enough to broadcast, so that all queries take the way
they take on large and skewed tables.
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks.oracle import ORACLE  # noqa: E402
from checks.registry import QUERIES  # noqa: E402
from linestream import scale  # noqa: E402
from linestream.session import local_session  # noqa: E402


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool) or v is None:
        return v
    return str(v)


def rows_of(cols: list[str], rows) -> Counter:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


def oracle_rows(sf: str, sql: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return cols, rows_of(cols, cur.fetchall())


def main() -> int:
    args = [a for a in sys.argv[1:] if a != "--hot"]
    sf, names = args[0], args[1:] or list(QUERIES)
    if "--hot" in sys.argv:
        scale.HOT_ROWS, scale.BROADCAST_ROWS = 40, 0
    spark = local_session()
    bad = 0
    for n in names:
        t = time.time()
        try:
            df = QUERIES[n](spark, sf)
            got = rows_of(df.columns, df.collect())
            took = time.time() - t
            if n not in ORACLE:
                print(f"rows  {n:30s} {sum(got.values()):8d} {took:7.2f}s", flush=True)
                continue
            t = time.time()
            cols, want = oracle_rows(sf, ORACLE[n])
            sql = time.time() - t
            if sorted(cols) != sorted(df.columns):
                raise AssertionError(f"columns {sorted(df.columns)} != {sorted(cols)}")
            if got != want:
                raise AssertionError(
                    f"{sum(got.values())} / {sum(want.values())} rows; only Spark {list((got - want).items())[:2]};"
                    f" only SQL {list((want - got).items())[:2]}"
                )
            print(f"ok    {n:30s} {sum(got.values()):8d} {took:7.2f}s  sql {sql:6.2f}s", flush=True)
        except Exception as e:
            bad += 1
            print(f"FAIL  {n:30s} {type(e).__name__}: {str(e)[:900]}", flush=True)
    print(f"{len(names) - bad} of {len(names)} match")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
