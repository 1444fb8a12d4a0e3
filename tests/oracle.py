"""Compares a Spark result with its SQL oracle in DuckDB: names, types and rows in any order."""

from __future__ import annotations

import glob
import math
import os

import duckdb

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return db


def _key(row: tuple) -> tuple:
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) or (math.isnan(a) and math.isnan(b))
    return a == b


def difference(df, db, sql: str) -> str:
    """Empty if the results agree, else what differs first."""
    names = sorted(df.columns)
    cursor = db.execute(f"SELECT * FROM ({sql})")
    have = {d[0]: str(d[1]) for d in cursor.description}
    if sorted(have) != names:
        return f"columns {names} and {sorted(have)}"
    kinds = {n: (KINDS.get(k, k), have[n]) for n, k in df.dtypes}
    if wrong := {n: k for n, k in kinds.items() if k[0] != k[1]}:
        return f"types {wrong}"
    place = [d[0] for d in cursor.description]
    want = sorted((tuple(r[place.index(n)] for n in names) for r in cursor.fetchall()), key=_key)
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=_key)
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    for a, b in zip(got, want, strict=True):
        if not all(map(_same, a, b)):
            return f"{dict(zip(names, a, strict=True))} and {dict(zip(names, b, strict=True))}"
    return ""
