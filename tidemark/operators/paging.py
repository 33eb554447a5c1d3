"""Pages of sorted results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyset_page(df: DataFrame, at: str, key: str, size: int, before: tuple | None = None, after: tuple | None = None) -> DataFrame:
    """A page, newest first, before or after a (at, key); size + 1 rows, so that the caller sees whether there is more."""
    place = lambda x: F.struct(F.lit(x[0]).cast(df.schema[at].dataType), F.lit(x[1]).cast(df.schema[key].dataType))
    own = F.struct(F.col(at), F.col(key))
    if after is not None:
        page = df.where(own > place(after)).orderBy(at, key).limit(size + 1)
        return page.orderBy(F.desc(at), F.desc(key))
    return (df.where(own < place(before)) if before is not None else df).orderBy(F.desc(at), F.desc(key)).limit(size + 1)


def offset_page(df: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """Page number `page` (from 1). A top-k of page * size rows, then a slice of it; no task holds more."""
    return df.orderBy(*order).limit(page * size).offset((page - 1) * size)


def top(df: DataFrame, order: list, k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def grouped_order(df: DataFrame, group: str, key: str) -> DataFrame:
    """df with group_size and place: groups by size, then name, stable inside."""
    n = df.withColumn("group_size", F.count("*").over(Window.partitionBy(group)))
    return n.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(key)))


def severity_at_least(column: Column, least: str, names: tuple[str, ...]) -> Column:
    """An ordered name at or above another."""
    return F.array_position(F.array(*map(F.lit, names)), column) >= names.index(least) + 1
