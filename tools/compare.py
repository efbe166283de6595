"""Run registered queries in Spark and their oracle SQL in DuckDB; compare
row count, column names and an order-insensitive value hash.

    python tools/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (dt.date,)):
        return v.isoformat()
    if isinstance(v, (bytes, bytearray)):
        return v.hex()
    return v


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(json.dumps([norm(r[i]) for i in order], default=str) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]


def main():
    import duckdb
    from cobframe.plans import catalog
    from cobframe.session import local_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(catalog.queries())
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    qs, sqls = catalog.queries(), catalog.oracle_sql()
    ok_all = True
    for n in names:
        t0 = time.time()
        try:
            df = qs[n](spark, sf)
            cols = df.columns
            rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"{n:28s} SPARK ERROR {str(e)[:300]}")
            ok_all = False
            continue
        ts = time.time() - t0
        if n not in sqls:
            print(f"{n:28s} rows={len(rows)} (no oracle) {ts:.1f}s")
            continue
        try:
            res = con.execute(sqls[n])
            ocols = [d[0] for d in res.description]
            orows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{n:28s} SQL ERROR {str(e)[:300]}")
            ok_all = False
            continue
        same_cols = sorted(cols) == sorted(ocols)
        h1, h2 = digest(cols, rows), digest(ocols, orows)
        ok = same_cols and len(rows) == len(orows) and h1 == h2
        ok_all &= ok
        print(f"{n:28s} {'OK ' if ok else 'BAD'} rows={len(rows)}/{len(orows)} "
              f"cols={'=' if same_cols else (sorted(cols), sorted(ocols))} "
              f"hash={'=' if h1 == h2 else 'DIFF'} {ts:.1f}s")
    print("ALL OK" if ok_all else "SOME FAILED")


if __name__ == "__main__":
    main()
