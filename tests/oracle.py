"""Compare a registered query with its SQL in DuckDB, value by value."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        if os.path.exists(path):
            connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return connection


def differences(frame, connection: duckdb.DuckDBPyConnection, sql: str) -> tuple[int, Counter, Counter]:
    """Number of rows expected, rows missing from `frame`, and rows it has too many."""
    columns = sorted(frame.columns)
    result = connection.sql(sql)
    assert sorted(result.columns) == columns, (sorted(result.columns), columns)
    expected = Counter(result.select(", ".join(f'"{c}"' for c in columns)).fetchall())
    actual = Counter(tuple(row) for row in frame.select(*columns).collect())
    return sum(expected.values()), expected - actual, actual - expected
