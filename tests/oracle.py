"""Runs registered queries beside their SQL in DuckDB and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return (0, "")
    if isinstance(x, bool):
        return (1, float(x))
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return (1, round(float(x), 5))
    return (2, str(x))


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def near(a, b) -> bool:
    return a == b or (a[0] == b[0] == 1 and abs(a[1] - b[1]) <= 2e-5 * max(1.0, abs(a[1])))


def difference(df, con, sql: str) -> str:
    """What differs between a DataFrame and a query; empty if nothing does."""
    got = df.collect()
    cur = con.execute(sql)
    names, want = [d[0] for d in cur.description], cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows(df.columns, got), rows(names, want)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    for x, y in zip(a, b, strict=True):
        if not all(near(p, q) for p, q in zip(x, y, strict=True)):
            return f"{x} and {y}"
    return ""
