"""Runs a query and its SQL over the same tables and compares the rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
from pyspark.sql import DataFrame


def canonical(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(canonical(x) for x in value)
    if hasattr(value, "item"):
        return canonical(value.item())
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, bool):
        return value
    if hasattr(value, "as_tuple"):
        return canonical(float(value))
    return value


def rows_of(df: DataFrame) -> Counter:
    names = sorted(df.columns)
    return Counter(tuple(canonical(r[c]) for c in names) for r in df.collect())


def sql_rows(sf_dir: str, query: str, tables) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cur = con.execute(query)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(canonical(r[i]) for i in order) for r in cur.fetchall())
