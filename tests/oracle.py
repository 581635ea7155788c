"""Comparing a query with its SQL in DuckDB: same columns, same rows in any order."""

from __future__ import annotations

import glob
import math
import os

import duckdb

DATA = os.environ.get("TEST_DATA", "/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v: object) -> object:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}")
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def differences(df, sql: str, c: duckdb.DuckDBPyConnection) -> str | None:
    """What differs first, or None."""
    want = c.execute(sql)
    names = [d[0] for d in want.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    kinds = dict(zip(names, (str(d[1]) for d in want.description), strict=True))
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for name, kind in df.dtypes:
        if pairs.get(kind, kinds[name]) != kinds[name]:
            return f"{name}: {kind} and {kinds[name]}"
    ours = sorted((tuple(plain(r[n]) for n in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[names.index(n)]) for n in order) for r in want.fetchall()), key=repr)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows and {len(theirs)}"
    return next((f"{a} and {b}" for a, b in zip(ours, theirs, strict=True) if a != b), None)
