"""Runs registered queries and their SQL side by side: python tests/compare.py [sf] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def norm(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def table(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con, sql: str) -> str | None:
    """None when both give the same columns and rows."""
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = table(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if got != want:
        only = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
        return f"rows {len(got)} vs {len(want)}; only spark {only[0]}; only sql {only[1]}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tests.session import make_session

    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = make_session(), connect(f"/root/testdata/sf{sf}")
    bad = 0
    for name, fn in entry.queries().items():
        if len(args) > 1 and name not in args[1:]:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            sql = entry.oracle_sql().get(name)
            problem = difference(df, con, sql) if sql else None
            note = "ok" if sql else f"rows only ({df.count()})"
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else note:10s} {time.time() - start:6.1f}s {name} {problem or ''}", flush=True)
    print("failed:", bad)
