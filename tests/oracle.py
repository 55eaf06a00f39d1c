"""Compare a query with its SQL in DuckDB: column names, row counts, and values sorted, with floats to nine digits."""

from __future__ import annotations

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET threads TO 4")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return c


def _plain(v: object) -> object:
    if isinstance(v, bool) or v is None:
        return v
    if hasattr(v, "as_integer_ratio"):
        v = float(v)
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return datetime.datetime(v.year, v.month, v.day).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def rows(names: list[str], values: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in values), key=repr)


def differ(spark, sf_dir: str, query, sql: str) -> str | None:
    """What is different, or None."""
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    c = connect(sf_dir)
    rel = c.execute(sql)
    names = [d[0] for d in rel.description]
    want = rows(names, rel.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    for g, w in zip(got, want):
        if g != w and not all(a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-9) for a, b in zip(g, w)):
            return f"{g} and {w}"
    return None
