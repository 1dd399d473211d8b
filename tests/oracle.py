"""Holds queries against their DuckDB SQL on the same tables."""

from __future__ import annotations

import datetime
from pathlib import Path

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        files = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{files}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 5) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def assert_same(df, con, sql: str) -> None:
    columns = sorted(df.columns)
    result = con.sql(sql)
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    want = sorted(repr(tuple(plain(row[i]) for i in at)) for row in result.fetchall())
    got = sorted(repr(tuple(plain(x) for x in row)) for row in df.select(*columns).collect())
    assert got == want
