"""Side-by-side comparison of a query with its oracle SQL.

Usage: python tests/oracle.py <sf_dir> [name prefix ...]
"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from guardlens.plans.registry import load  # noqa: E402
from guardlens.plans.views import TABLES  # noqa: E402


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return "0" if v == 0 else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def kind(v):
    return "number" if isinstance(v, (int, float)) and not isinstance(v, bool) else type(v).__name__


def compare(spark, con, q, sf):
    """None when equal, else a text saying what differs."""
    df = q.run(spark, sf)
    rows = [tuple(r) for r in df.collect()]
    if q.sql is None:
        return None if df.columns else "no columns"
    cur = con.execute(q.sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    si, di = [df.columns.index(c) for c in sorted(cols)], [cols.index(c) for c in sorted(cols)]
    a = sorted(tuple(canon(r[i]) for i in si) for r in rows)
    b = sorted(tuple(canon(r[i]) for i in di) for r in want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; e.g. spark-only {list(set(a) - set(b))[:2]} sql-only {list(set(b) - set(a))[:2]}"
    if a != b:
        return f"values differ ({len(set(a) - set(b))}/{len(a)}): {sorted(cols)} spark {list(set(a) - set(b))[:2]} sql {list(set(b) - set(a))[:2]}"
    if rows:
        for c, i, j in zip(sorted(cols), si, di):
            ka = {kind(r[i]) for r in rows if r[i] is not None}
            kb = {kind(r[j]) for r in want if r[j] is not None}
            ta = {type(r[i]).__name__ for r in rows if r[i] is not None}
            tb = {type(r[j]).__name__ for r in want if r[j] is not None}
            if ka != kb or (ta != tb and "Decimal" in str(ta | tb)):
                return f"type of {c}: {ta} != {tb}"
            if ("float" in ta) != ("float" in tb):
                return f"type of {c}: {ta} != {tb}"
    elif q.name not in EMPTY_OK:
        return "no rows on either side"
    return None


EMPTY_OK: set[str] = set()


def main():
    from guardlens.session import local_session
    sf, prefixes = sys.argv[1], sys.argv[2:]
    spark, con = local_session(8, 8), connect(sf)
    bad = n = 0
    for name, q in load().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        n += 1
        t = time.time()
        try:
            msg = compare(spark, con, q, sf)
        except Exception as e:  # noqa: BLE001
            msg = f"{type(e).__name__}: {str(e)[:600]}"
        dt = time.time() - t
        if msg:
            bad += 1
        print(f"{'FAIL' if msg else 'ok  '} {name} {dt:.2f}s{' (rows only)' if q.sql is None else ''} {msg or ''}"[:900], flush=True)
    print(f"{n - bad}/{n} ok")


if __name__ == "__main__":
    main()
