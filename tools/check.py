"""Compare registered queries with their SQL in DuckDB.

Usage: python tools/check.py SF_DIR [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from textloom.plans.registry import load  # noqa: E402
from textloom.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def canonical(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, connection, name: str, sf_dir: str) -> tuple[bool, str]:
    query = load()[name]
    start = time.time()
    frame = query.plan(spark, sf_dir)
    got = [tuple(r) for r in frame.collect()]
    took = time.time() - start
    if query.sql is None:
        return bool(got), f"{took:6.1f}s rows={len(got)} (no SQL) {frame.schema.simpleString()}"
    start = time.time()
    result = connection.execute(query.sql)
    columns = [d[0] for d in result.description]
    want = result.fetchall()
    sql_took = time.time() - start
    a, b = canonical(frame.columns, got), canonical(columns, want)
    note = f"{took:6.1f}s sql {sql_took:5.1f}s rows={len(got)}"
    if a == b:
        return True, note
    if a[0] != b[0]:
        return False, f"{note} columns {a[0]} != {b[0]}"
    ours, theirs = set(a[1]), set(b[1])
    return False, f"{note} want {len(want)}; only ours {sorted(ours - theirs)[:3]} only SQL {sorted(theirs - ours)[:3]}"


def main() -> int:
    sf_dir, names = sys.argv[1].rstrip("/"), sys.argv[2:] or list(load())
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "check")
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    bad = 0
    for name in names:
        try:
            good, note = compare(spark, connection, name, sf_dir)
        except Exception as error:  # noqa: BLE001 - report and go on
            good, note = False, f"{type(error).__name__}: {str(error)[:350].splitlines()[0]}"
        bad += not good
        print("ok  " if good else "FAIL", name, note, flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
