"""Strict comparison of a query with its SQL: names, row count, and exact values."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from genesieve.catalog.base import TABLES  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """DuckDB inside this process, with the tables as views."""
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(repr(normal(row[i])) for i in order) for row in rows)


def compare(spark, connection, query, sf_dir) -> str:
    """Empty when equal, else what differs."""
    df = query.run(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if query.sql is None:
        return "" if got else "no rows"
    result = connection.execute(query.sql)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if not got:
        return "no rows"
    a, b = rows_of(df.columns, got), rows_of(names, expected)
    if a != b:
        return (
            f"rows {len(got)} / {len(expected)}; only spark {list((a - b).items())[:3]}; "
            f"only sql {list((b - a).items())[:3]}"
        )
    return ""


if __name__ == "__main__":
    from genesieve.catalog import registry
    from genesieve.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session("8")
    connection = connect(sf_dir)
    bad = 0
    for name, q in registry().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            problem = compare(spark, connection, q, sf_dir)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(problem)
        print(f"{'ok ' if not problem else 'BAD'} {name} {time.time() - start:.1f}s "
              f"{'' if q.sql else '(rows only) '}{problem}", flush=True)
    print(f"{bad} bad")
