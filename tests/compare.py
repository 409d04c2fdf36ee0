"""Run registered queries on Spark and their SQL on DuckDB and compare the rows.

    python tests/compare.py [substring ...]      # SF_DIR picks the data folder
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(folder: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.12g}") + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return dt.datetime(v.year, v.month, v.day).isoformat()
    if isinstance(v, dict):
        return tuple(sorted((str(k), norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, norm(x)) for k, x in v.asDict().items()))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, folder, name, query, sql):
    df = query(spark, folder)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return None, f"rows only: {len(got)}"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}"
    if len(got) != len(want):
        return False, f"{len(got)} rows != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return False, f"{len(bad)} of {len(got)} rows differ; columns {sorted(cols)}\n   spark  {bad[0][0]}\n   duckdb {bad[0][1]}"
    return True, f"{len(got)} rows"


def main():
    from hearthmark.plans.catalog import ORACLES, QUERIES
    from hearthmark.session import build_session
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    if os.environ.get("PLAIN"):  # a session that sets nothing of ours
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
                 .config("spark.driver.memory", "12g").getOrCreate())
    else:
        spark = build_session("compare", "local[8]")
    con = duck(folder)
    pats = sys.argv[1:]
    fails = 0
    for name, fn in QUERIES.items():
        if pats and not any(p in name for p in pats):
            continue
        t = time.time()
        try:
            ok, msg = compare(spark, con, folder, name, fn, ORACLES.get(name))
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{type(e).__name__}: {str(e)[:1500]}"
        fails += ok is False
        print(f"{ {True: 'ok  ', False: 'FAIL', None: 'rows'}[ok] } {name:34s} {time.time() - t:6.2f}s {msg}", flush=True)
    print("failures:", fails)


if __name__ == "__main__":
    main()
