"""Side-by-side comparison of a Spark query with its SQL oracle."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP"}


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads=8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, dt.datetime) and (v.hour, v.minute, v.second, v.microsecond) == (0, 0, 0, 0):
        return v.date().isoformat() + "T0"
    return repr(v)


def compare(df, con, sql: str) -> str:
    """Empty text when both agree, else what differs."""
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    theirs = cur.fetchall()
    mine_cols = df.columns
    if sorted(cols) != sorted(mine_cols):
        return f"columns {sorted(mine_cols)} vs {sorted(cols)}"
    types = {c: t for c, t in df.dtypes}
    off = {c: (types[c], kinds[c]) for c in cols if KINDS.get(types[c]) != kinds[c]}
    order = sorted(cols)
    a = sorted(tuple(_norm(r[c]) for c in order) for r in df.collect())
    at = [cols.index(c) for c in order]
    b = sorted(tuple(_norm(r[i]) for i in at) for r in theirs)
    note = f" types {off}" if off else ""
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}{note}"
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} of {len(a)} rows differ, e.g. {order}\n   spark {bad[0][0]}\n   duck  {bad[0][1]}{note}"
    if off:
        return f"equal values,{note}"
    return "" if a else "EMPTY"
