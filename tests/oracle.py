"""Compare registered queries with their SQL in DuckDB: ``python tests/oracle.py [DIR] [NAME-PREFIX...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).parents[1]))


def normal(v):
    import datetime
    import math

    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def duck(directory: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(directory).glob("*.parquet")):
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{src}'")
    return con


def compare(spark, con, directory, name, query, sql) -> str:
    df = query(spark, directory)
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if cols != want_cols:
        return f"columns {cols} <> {want_cols}"
    if got != want:
        a, b = set(map(repr, got)), set(map(repr, want))
        return f"rows {len(got)} <> {len(want)}; only Spark {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as e
    from lodeplane.session import local_session

    args = sys.argv[1:]
    directory = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, q, o = duck(directory), e.queries(), e.oracle_sql()
    bad = 0
    for n in q:
        if args and not any(n.startswith(a) for a in args):
            continue
        t = time.time()
        try:
            said = compare(spark, con, directory, n, q[n], o[n]) if n in o else f"no SQL; rows {q[n](spark, directory).count()}"
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__} {str(x)[:600]}"
        bad += bool(said) and n in o
        print(f"{n}: {said or 'ok'} ({time.time() - t:.1f} s)", flush=True)
    print("mismatches:", bad)
