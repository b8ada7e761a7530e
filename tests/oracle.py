"""Compare a catalogued query with its SQL on the same Parquet tables."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')"
        )
    return connection


def _plain(value):
    if isinstance(value, Decimal):
        return f"{value.normalize():f}"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return repr(value)


def rows_of(columns: list[str], rows) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([_plain(row[i]) for i in order]) for row in rows)


def expected(connection, sql: str):
    result = connection.execute(sql)
    columns = [column[0] for column in result.description]
    return sorted(columns), rows_of(columns, result.fetchall())


def actual(df):
    return sorted(df.columns), rows_of(df.columns, [tuple(row) for row in df.collect()])
