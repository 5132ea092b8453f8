"""Comparing a Spark result with the SQL run by DuckDB, without regard to row order."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connection(sf: str) -> duckdb.DuckDBPyConnection:
    database = duckdb.connect()
    for name in TABLES:
        path = Path(sf) / f"{name}.parquet"
        if path.exists():
            database.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return database


def cell(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, list):
        return tuple(cell(part) for part in value)
    return (type(value).__name__, value)


def spark_rows(df):
    names = sorted(df.columns)
    return names, Counter(tuple(cell(row[name]) for name in names) for row in df.collect())


def duck_rows(database, sql):
    cursor = database.execute(sql)
    found = [column[0] for column in cursor.description]
    names = sorted(found)
    order = [found.index(name) for name in names]
    return names, Counter(tuple(cell(row[i]) for i in order) for row in cursor.fetchall())
