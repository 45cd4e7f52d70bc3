"""Holds each query against its SQL in DuckDB, as sorted rows."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def rows(names: list[str], found) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in found), key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(connection, df, sql: str) -> str:
    """Empty if both give the same rows."""
    want = connection.sql(sql)
    if sorted(want.columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(want.columns)}"
    a, b = rows(df.columns, df.collect()), rows(want.columns, want.fetchall())
    if a != b:
        only = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return f"{len(a)} and {len(b)} rows; first difference {only}"
    return ""
