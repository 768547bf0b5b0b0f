"""Run registered queries in Spark and their SQL oracle in DuckDB and compare
(row count, column names, order-insensitive values).

usage: python tests/oracle_harness.py [sf_dir] [key ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from kestrel.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, nd):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, nd)
    if isinstance(v, decimal.Decimal):
        return round(float(v), nd)
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, nd) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist(), nd)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, nd)) for k, x in v.items()))
    return v


def rows_of(names, rows, nd):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_norm(r[i], nd) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, con, key, fn, sql, sf_dir, nd=4):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_names = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = {"key": key, "spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    from kestrel.plans.registry import ROUND_COLS
    from pyspark.sql import types as T
    unr = [f.name for f in sdf.schema.fields if isinstance(f.dataType, T.DoubleType)
           and f.name not in ROUND_COLS.get(key, ())]
    if unr:
        res["unrounded"] = unr
    cur = con.execute(sql)
    d_names = [d[0] for d in cur.description]
    d_rows = cur.fetchall()
    res["duck_rows"] = len(d_rows)
    if sorted(s_names) != sorted(d_names):
        res["status"] = f"COLUMNS {sorted(s_names)} vs {sorted(d_names)}"
        return res
    if len(s_rows) != len(d_rows):
        res["status"] = "ROWCOUNT"
        return res
    a, b = rows_of(s_names, s_rows, nd), rows_of(d_names, d_rows, nd)
    exact = rows_of(s_names, s_rows, 12) == rows_of(d_names, d_rows, 12)
    if a == b:
        res["status"] = "ok" if exact else "ok~"
        if not exact:
            ea, eb = rows_of(s_names, s_rows, 12), rows_of(d_names, d_rows, 12)
            res["exact_diff"] = [(x, y) for x, y in zip(ea, eb) if x != y][:2]
    else:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        res["status"] = f"VALUES {len(bad)} differ, e.g. {bad[:2]}"
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    from __spark_entry__ import oracle_sql, queries
    from kestrel.session import build_session

    spark = build_session(shuffle_partitions=8)
    con = duck(sf_dir)
    qs, os_ = queries(), oracle_sql()
    bad = 0
    for k in keys or sorted(qs):
        try:
            r = compare(spark, con, k, qs[k], os_.get(k), sf_dir)
        except Exception as e:  # noqa: BLE001
            r = {"key": k, "status": f"ERROR {type(e).__name__}: {str(e)[:300]}"}
        if not r["status"].startswith(("ok", "rows")):
            bad += 1
        print(r, flush=True)
    print(f"{len(keys or qs)} keys, {bad} failing")


if __name__ == "__main__":
    main(sys.argv)
