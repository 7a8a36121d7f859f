"""Compare a registered Spark query with its DuckDB oracle statement.

Order-insensitive: columns are matched by name, rows sorted; doubles must
agree to 1e-9 relative (they are rounded identically on both sides, so in
practice they are equal).
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "")
        return (1, v)
    if hasattr(v, "isoformat"):
        return (1, v.isoformat())
    if isinstance(v, (list, tuple)):
        return (1, repr(v))
    return (1, v)


def _key(row):
    return tuple((t, str(v)) if not isinstance(v, (int, float)) else (t, v) for t, v in row)


def _eq(a, b) -> bool:
    (ta, va), (tb, vb) = a, b
    if ta != tb:
        return False
    if isinstance(va, float) or isinstance(vb, float):
        try:
            fa, fb = float(va), float(vb)
        except (TypeError, ValueError):
            return False
        return fa == fb or abs(fa - fb) <= 1e-9 * max(1.0, abs(fa), abs(fb))
    return va == vb


def compare(spark, name: str, sf_dir: str, con=None) -> tuple[bool, str]:
    from mercata.plans.oracle import SQL
    from mercata.plans.registry import QUERIES

    t0 = time.time()
    sdf = QUERIES[name](spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    con = con or duck(sf_dir)
    res = con.execute(SQL[name])
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    t2 = time.time()
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark={s_cols} duck={d_cols}"
    order = sorted(s_cols)
    si = [s_cols.index(c) for c in order]
    di = [d_cols.index(c) for c in order]
    s_n = sorted((tuple(_norm(r[i]) for i in si) for r in s_rows), key=_key)
    d_n = sorted((tuple(_norm(r[i]) for i in di) for r in d_rows), key=_key)
    if len(s_n) != len(d_n):
        return False, f"row count spark={len(s_n)} duck={len(d_n)}"
    for a, b in zip(s_n, d_n):
        if not all(_eq(x, y) for x, y in zip(a, b)):
            return False, f"first differing row (cols {order}):\n spark={a}\n duck ={b}"
    return True, f"{len(s_n)} rows, spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s"


def main(argv: list[str]) -> int:
    from mercata.plans.oracle import SQL
    from mercata.session import build_session

    sf_dir = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
    names = argv or sorted(SQL)
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            ok, msg = compare(spark, n, sf_dir, con)
        except Exception as e:  # report and continue
            ok, msg = False, f"{type(e).__name__}: {str(e)[:800]}"
        bad += not ok
        print(("OK  " if ok else "FAIL"), n, msg, flush=True)
    print(f"{len(names) - bad}/{len(names)} match")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
