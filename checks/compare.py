"""Run queries on Spark and their SQL on DuckDB and compare the rows.

    python -m checks.compare [--folder DIR] [NAME ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import sys
import time
from collections import Counter

import duckdb

from checks.registry import all_oracles, all_queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value: object) -> object:
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "NaN" if value != value else float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def as_bag(columns: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(name: str, spark, con: duckdb.DuckDBPyConnection, folder: str) -> tuple[bool, str]:
    frame = all_queries()[name](spark, folder)
    columns, rows = frame.columns, [tuple(r) for r in frame.collect()]
    sql = all_oracles().get(name)
    if sql is None:
        return True, f"{len(rows)} rows, no SQL"
    result = con.execute(sql)
    expected_columns = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(columns) != sorted(expected_columns):
        return False, f"columns {sorted(columns)} != {sorted(expected_columns)}"
    mine, theirs = as_bag(columns, rows), as_bag(expected_columns, expected)
    if mine == theirs:
        return True, f"{len(rows)} rows"
    extra, lacking = list((mine - theirs).items())[:3], list((theirs - mine).items())[:3]
    return False, f"{len(rows)} != {len(expected)} rows\n   spark only {extra}\n   sql only {lacking}"


def main() -> int:
    from netquarry.session import build_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--folder", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    arguments = parser.parse_args()
    spark = build_session(
        "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(arguments.folder)
    failed = []
    names = [
        n for n in all_queries() if not arguments.names or any(n.startswith(p) for p in arguments.names)
    ]
    for name in names:
        started = time.time()
        try:
            ok, message = compare(name, spark, con, arguments.folder)
        except Exception as error:
            ok, message = False, f"{type(error).__name__}: {str(error)[:1500]}"
        print(flush=True)
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - started:.1f}s {message}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(names) - len(failed)} of {len(names)} agree; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
