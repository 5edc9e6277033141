"""Run a query and its SQL twin on the same tables and compare names, types and values."""

from __future__ import annotations

import glob
import math
import os

import duckdb

SAME_TYPE = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
    "timestamp": "TIMESTAMP",
    "array<string>": "VARCHAR[]",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _sortable(row: tuple) -> tuple:
    return tuple((v is not None, str(type(v)), v if v is not None else 0) for v in row)


def _clean(v):
    return None if isinstance(v, float) and math.isnan(v) else v


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Differences found, none when the two agree."""
    twin = con.sql(sql)
    ours, theirs = dict(df.dtypes), dict(zip(twin.columns, map(str, twin.types)))
    if set(ours) != set(theirs):
        return [f"columns {sorted(ours)} vs {sorted(theirs)}"]
    problems = [
        f"type of {c}: {ours[c]} vs {theirs[c]}" for c in ours if SAME_TYPE.get(ours[c], ours[c]) != theirs[c]
    ]
    names = sorted(ours)
    a = sorted((tuple(_clean(r[c]) for c in names) for r in df.collect()), key=_sortable)
    at = [twin.columns.index(c) for c in names]
    b = sorted((tuple(_clean(r[i]) for i in at) for r in twin.fetchall()), key=_sortable)
    if len(a) != len(b):
        problems.append(f"rows {len(a)} vs {len(b)}")
    different = [(x, y) for x, y in zip(a, b) if x != y]
    if different:
        problems.append(f"{len(different)} rows differ, first {names}: {different[0]}")
    return problems
