"""Run registered queries in Spark and their SQL in DuckDB; compare like the driver.

Row count, column names and an order-insensitive comparison of rounded values.
Usage: python tests/oracle_compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.9g}")
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(records, cols):
    order = sorted(cols)
    out = [tuple(_norm(r[c]) for c in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark, sf_dir: str, names=None, verbose=True):
    import __spark_entry__ as E
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            srows = [r.asDict() for r in sdf.collect()]
            scols = sdf.columns
        except Exception as e:  # noqa: BLE001
            results[name] = ("spark-error", repr(e)[:400])
            continue
        ts = time.time() - t0
        if name not in sqls:
            results[name] = ("rows-only", len(srows), round(ts, 2))
            continue
        try:
            cur = con.execute(sqls[name])
            dcols = [d[0] for d in cur.description]
            drows = [dict(zip(dcols, r)) for r in cur.fetchall()]
        except Exception as e:  # noqa: BLE001
            results[name] = ("sql-error", repr(e)[:400])
            continue
        if sorted(scols) != sorted(dcols):
            results[name] = ("columns", sorted(set(scols) ^ set(dcols)))
            continue
        a, b = rows_of(srows, scols), rows_of(drows, dcols)
        if len(a) != len(b):
            results[name] = ("rowcount", len(a), len(b))
        elif a != b:
            diffs = [(x, y) for x, y in zip(a, b) if x != y][:3]
            results[name] = ("values", sorted(scols), diffs)
        else:
            results[name] = ("ok", len(a), round(ts, 2))
    return results


if __name__ == "__main__":
    from varkit.session import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_session()
    for k, v in compare(spark, sf, names).items():
        print(k, v, flush=True)
