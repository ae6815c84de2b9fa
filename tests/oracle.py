"""Compare registered queries with their DuckDB twins (also a small command)."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, str, int)):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        return f"dec:{v.normalize()}"
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(sorted((str(k), plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(
        (tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: repr(r)
    )


def compare(spark, con, fn, sql, sf):
    """Empty text when equal, else what differs."""
    df = fn(spark, sf)
    a_names, a = normal(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    b_names, b = normal([d[0] for d in cur.description], cur.fetchall())
    if a_names != b_names:
        return f"columns {a_names} != {b_names}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"{a_names}\n  spark  {x}\n  duckdb {y}"
    return "" if a else "EMPTY"


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from prizelens.session import build_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(
        "oracle", "local[8]", 8,
        {"spark.ui.enabled": "false", "spark.driver.memory": "8g",
         "spark.sql.ui.retainedExecutions": "5"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        t = time.time()
        try:
            if name in oracles:
                out = compare(spark, con, fn, oracles[name], sf)
            else:
                n = fn(spark, sf).count()
                out = "" if n else "EMPTY"
        except Exception as e:  # report and go on
            out = f"{type(e).__name__}: {str(e)[:700]}"
        note = "" if name in oracles else " (rows only)"
        print(f"{'ok  ' if not out else 'FAIL'} {time.time()-t:6.2f}s {name}{note} {out}", flush=True)
        bad += bool(out)
    print(f"{bad} failures")


if __name__ == "__main__":
    main(sys.argv[1:])
