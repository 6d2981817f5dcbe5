"""Compares a registered query with its SQL on DuckDB."""

from __future__ import annotations

import datetime as dt
import decimal
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return ("f", repr(v + 0.0))
    if isinstance(v, bool) or v is None:
        return ("n", repr(v))
    if isinstance(v, dt.datetime):
        return ("s", v.isoformat())
    if isinstance(v, (list, tuple)):
        return ("l", repr([_plain(x) for x in v]))
    return ("s" if isinstance(v, str) else type(v).__name__, str(v))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql: str, sf_dir: str) -> str | None:
    """None when equal, else what differs first."""
    df = fn(spark, sf_dir)
    mine = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    theirs = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} vs {len(theirs)}"
    a, b = rows_of(df.columns, mine), rows_of(names, theirs)
    for x, y in zip(a, b):
        if x != y:
            return f"{sorted(names)}\n   spark {x}\n   sql   {y}"
    return None


def type_families(df, con, sql):
    """Columns whose type family differs between the two results."""
    fam = {"bigint": "int", "int": "int", "tinyint": "int", "double": "float", "string": "text", "date": "date",
           "boolean": "bool", "BIGINT": "int", "INTEGER": "int", "DOUBLE": "float", "VARCHAR": "text", "DATE": "date",
           "BOOLEAN": "bool"}
    other = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return {
        c: (t, other.get(c)) for c, t in df.dtypes if fam.get(t, t) != fam.get(other.get(c), other.get(c))
    }
