"""Runs named queries in Spark and in DuckDB and compares the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return repr(v + 0.0)
    return v if v is None else f"{type(v).__name__}:{v}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr), [columns[i] for i in order]


def difference(spark, con, name, query, sql, sf_dir) -> str | None:
    """None when equal, else the first difference."""
    df = query(spark, sf_dir)
    got, got_columns = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    want, want_columns = rows_of(columns, found.fetchall())
    if got_columns != want_columns:
        return f"{name}: columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"{name}: {len(got)} rows != {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"{name}: {g} != {w}"
    return None
