"""Compare a registered query with its DuckDB SQL (order-insensitive).

Usable as a script: ``python tests/oracle_compare.py [sf_dir] [key ...]``.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
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
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    out.sort(key=lambda t: tuple((x is None, str(x)) for x in t))
    return [cols[i] for i in order], out


def compare(spark, con, key: str, sf_dir: str, fn, sql: str) -> dict:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    sc, sr = _rows(s_cols, s_rows)
    dc, dr = _rows(d_cols, d_rows)
    out = {"key": key, "spark_rows": len(sr), "oracle_rows": len(dr), "cols_ok": sc == dc,
           "values_ok": sr == dr, "spark_s": round(t1 - t0, 2)}
    if not out["cols_ok"]:
        out["spark_cols"], out["oracle_cols"] = sc, dc
    elif not out["values_ok"]:
        diff_s = [r for r in sr if r not in set(dr)][:3]
        diff_d = [r for r in dr if r not in set(sr)][:3]
        out["only_spark"], out["only_oracle"] = diff_s, diff_d
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    import __spark_entry__ as ent
    from fleetlog.session import build_session
    spark = build_session()
    con = duck(sf_dir)
    qs, sqls = ent.queries(), ent.oracle_sql()
    bad = 0
    for k in keys or sorted(qs):
        if k not in sqls:
            df = qs[k](spark, sf_dir)
            print({"key": k, "rows_only": df.count()})
            continue
        try:
            r = compare(spark, con, k, sf_dir, qs[k], sqls[k])
        except Exception as e:  # report and go on
            r = {"key": k, "error": repr(e)[:500]}
        ok = r.get("cols_ok") and r.get("values_ok")
        bad += not ok
        print(("OK  " if ok else "BAD ") + str(r), flush=True)
    print(f"{bad} mismatching")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
