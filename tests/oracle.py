"""Runs a query on Spark and its SQL on DuckDB and compares the two as sets of rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if type(x).__name__ == "Decimal":
        return ("decimal", str(x))
    if hasattr(x, "isoformat"):
        return str(x)
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in data]
    return sorted(columns), sorted(out, key=repr)


def compare(spark, con, fn, sql: str, sf_dir: str) -> str:
    """'' when equal, else what differs."""
    df = fn(spark, sf_dir)
    got_cols, got = rows(df.columns, df.collect())
    cur = con.execute(sql)
    want_cols, want = rows([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} vs {want_cols}"
    if got == want:
        return "" if got else "both empty"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}: {sorted(set(got) - set(want), key=repr)[:2]} | {sorted(set(want) - set(got), key=repr)[:2]}"
    a, b = set(got), set(want)
    return f"{len(a - b)} of {len(got)} rows differ: {sorted(a - b, key=repr)[:2]} | {sorted(b - a, key=repr)[:2]}"
