"""Holds a query against its SQL: row count, columns, and values, whatever the order."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(columns: list[str], values: list[tuple]) -> list[tuple]:
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(r[i] for i in at) for r in values), key=lambda r: tuple((x is not None, str(x)) for x in r))


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if they agree; else what differs first."""
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    theirs = rows(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    if len(ours) != len(theirs):
        return f"{len(ours)} rows and {len(theirs)}"
    for a, b in zip(ours, theirs, strict=True):
        if a != b and not all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1e-9 * max(1, abs(x))) for x, y in zip(a, b, strict=True)):
            return f"{sorted(columns)}: {a!r} and {b!r}"
    return ""
