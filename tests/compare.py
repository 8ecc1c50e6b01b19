"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list:
    """Empty if columns and rows agree; else what differs, the first few."""
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    if sorted(names) != sorted(df.columns):
        return [("columns", sorted(names), sorted(df.columns))]
    want, have = rows_of(names, got.fetchall()), rows_of(df.columns, [tuple(r) for r in df.collect()])
    if len(want) != len(have):
        return [("rows", len(want), len(have))]
    return [(a, b) for a, b in zip(want, have, strict=True) if a != b][:3]
