"""Run registered queries on Spark and their SQL twins on DuckDB and compare the row sets.

    python tests/compare.py [--sf DIR] [NAME_PREFIX ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import threading
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


LAST = {"spark": 0.0}


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def _norm(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return repr(float(value) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_norm(v) for v in value) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def difference(spark, con, sf: str, fn, sql: str | None):
    """(row count, None) when equal, else (row count, description)."""
    began = time.time()
    df = fn(spark, sf)
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    LAST["spark"] = time.time() - began
    if sql is None:
        return len(got), None
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    want_columns, want = rows_of(columns, cursor.fetchall())
    if got_columns != want_columns:
        return len(got), f"columns {got_columns} <> {want_columns}"
    if got == want:
        return len(got), None
    have, need = set(got), set(want)
    missing, extra = sorted(need - have)[:2], sorted(have - need)[:2]
    return len(got), f"{len(got)} rows <> {len(want)}; missing {str(missing)[:600]}; extra {str(extra)[:600]}"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--limit", type=float, default=60.0, help="seconds after which a query is cancelled")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry
    from tidemark.session import build_session

    spark, con = build_session(), duck(args.sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        began = time.time()
        watch = threading.Timer(args.limit, lambda: (spark.sparkContext.cancelAllJobs(), con.interrupt()))
        watch.start()
        try:
            n, problem = difference(spark, con, args.sf, fn, oracle.get(name))
        except Exception as error:  # noqa: BLE001
            n, problem = 0, f"{type(error).__name__}: {str(error)[:900]}"
        watch.cancel()
        kind = "sql" if name in oracle else "rows"
        mark = "ok" if problem is None and n else ("EMPTY" if problem is None else "FAIL")
        failed += mark != "ok"
        print(f"{mark:5} {name:34} {kind:4} {n:7d} rows {LAST['spark']:6.2f}s of {time.time() - began:6.2f}s {problem or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
