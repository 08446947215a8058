"""Spark results against DuckDB on the same tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if hasattr(x, "as_tuple"):
        return round(float(x), 6)
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(value(r[i]) for i in order) for r in rows) if all(None not in r for r in rows) else sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def compare(con, frame, sql: str) -> str:
    """'' if both sides agree, else what differs."""
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    con.execute(sql)
    names = [d[0] for d in con.description]
    want = rows_of(names, con.fetchall())
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w and not all(a == b or (isinstance(a, float) and isinstance(b, (int, float)) and abs(a - b) <= 2e-6) for a, b in zip(g, w))]
    return f"{len(bad)} rows differ: {bad[0]}" if bad else ""
