"""Compares every registered query with its SQL statement; `python -m tests.compare [sf] [names]`."""

from __future__ import annotations

import datetime as dt
import decimal
import sys
import time
from collections import Counter

import duckdb

import __spark_entry__ as entry

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "benchmark", "labels"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return ("dec", str(value.normalize() + 0))
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, int):
        return ("dec", str(decimal.Decimal(value).normalize() + 0))
    if isinstance(value, dt.datetime):
        return ("time", value.isoformat())
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    start = time.time()
    df = entry.queries()[name](spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    seconds = time.time() - start
    result = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    theirs = rows_of(columns, result.fetchall())
    same = sorted(columns) == sorted(df.columns) and ours == theirs
    note = f"{name}: {sum(ours.values())} rows, {sum(theirs.values())} expected, {seconds:.1f}s"
    if not same:
        note += f"\n  columns {sorted(df.columns)} / {sorted(columns)}"
        note += f"\n  only ours {list((ours - theirs).items())[:2]}\n  only theirs {list((theirs - ours).items())[:2]}"
    return same, note


def main() -> int:
    from leasebook import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    sf_dir = f"/root/testdata/{sf}"
    spark, con = build_session(cpus=8), connect(sf_dir)
    names = sys.argv[2:] or list(entry.queries())
    failed = []
    for name in names:
        if name not in entry.oracle_sql():
            print("NO SQL", name, flush=True)
            continue
        try:
            same, note = compare(spark, con, name, sf_dir)
        except Exception as error:  # report and go on
            same, note = False, f"{name}: {str(error)[:400]}"
        print("ok  " if same else "FAIL", note, flush=True)
        if not same:
            failed.append(name)
    print(f"{len(names) - len(failed)} of {len(names)} equal; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
