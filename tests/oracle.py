"""Compare registered queries with their SQL in DuckDB.

``python tests/oracle.py [folder] [name ...]`` prints one line per query that differs.
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return repr([_cell(x) for x in v])
    return repr(v)


def _normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(df, con, sql: str) -> str | None:
    """None if both give the same names and rows, else what differs."""
    spark_names, spark_rows = _normal(df.columns, [tuple(x) for x in df.collect()])
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    sql_names, sql_rows = _normal(names, res.fetchall())
    if spark_names != sql_names:
        return f"columns {spark_names} != {sql_names}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} != {len(sql_rows)}"
    bad = [(a, b) for a, b in zip(spark_rows, sql_rows) if a != b]
    return f"{len(bad)} of {len(sql_rows)} rows differ, first {bad[0]}" if bad else None


def main() -> None:
    from conftest import make_session

    import __spark_entry__ as e

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = set(sys.argv[2:])
    spark, con = make_session(), connect(folder)
    oracles, bad = e.oracle_sql(), 0
    for name, fn in e.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in oracles:
                msg = difference(fn(spark, folder), con, oracles[name])
                note = "ok"
            else:
                msg, note = None, f"rows only: {fn(spark, folder).count()}"
        except Exception as exc:  # noqa: BLE001
            msg = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += msg is not None
        print(f"{'BAD ' if msg else 'ok  '} {name} {time.time() - start:.1f}s {msg or note}", flush=True)
    print("bad:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
