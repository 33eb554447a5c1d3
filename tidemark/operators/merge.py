"""Idempotent merges of a staged batch into stored rows: the same batch again changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_each(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in `order`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def _both(stored: DataFrame, staged: DataFrame) -> DataFrame:
    return stored.withColumn("__staged", F.lit(0)).unionByName(staged.withColumn("__staged", F.lit(1)))


def insert_ignore(stored: DataFrame, staged: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Stored rows, and staged ones of new keys (the first in `order` of each)."""
    return first_each(_both(stored, staged), keys, ["__staged", *order]).drop("__staged")


def insert_counts(stored: DataFrame, staged: DataFrame, keys: list[str]) -> DataFrame:
    """staged, inserted, conflicts: what insert_ignore does with the rows of a batch."""
    new = staged.select(*keys).distinct().join(stored.select(*keys), keys, "left_anti").agg(F.count("*").alias("inserted"))
    return staged.agg(F.count("*").alias("staged")).crossJoin(new).withColumn("conflicts", F.col("staged") - F.col("inserted"))


def best_wins(stored: DataFrame, staged: DataFrame, keys: list[str], better: str, order: list = ()) -> DataFrame:
    """For each key the row with the largest `better`; a stored row wins a tie."""
    return first_each(_both(stored, staged), keys, [F.desc_nulls_last(better), "__staged", *order]).drop("__staged")


def newest_wins(stored: DataFrame, staged: DataFrame, keys: list[str], at: str, fields: list[str], first: str, last: str) -> DataFrame:
    """Fields of the newest row that knows them, first and last widened. Null is unknown and keeps what was known."""
    both = _both(stored, staged)
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.col(at), F.lit(1) - F.col("__staged"), F.col(c)))).alias(c)
    return both.groupBy(*keys).agg(F.min(first).alias(first), F.max(last).alias(last), *map(newest, fields))


def widened(stored: DataFrame, staged: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
    """Pairs with the earliest first and the latest last."""
    return stored.unionByName(staged).groupBy(*keys).agg(F.min(first).alias(first), F.max(last).alias(last))


def added_up(stored: DataFrame, staged: DataFrame, keys: list[str], sums: list[str], most: list[str]) -> DataFrame:
    """Counters added, maxima kept; null counts as absent."""
    return stored.unionByName(staged).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums), *(F.max(c).alias(c) for c in most))


def replays(batches: DataFrame, keys: list[str], at: str) -> DataFrame:
    """keys, first_at, replays: a batch that comes again is the same row once more."""
    return batches.groupBy(*keys).agg(F.min(at).alias("first_at"), (F.count("*") - 1).alias("replays"))


def changed(stored: DataFrame, staged: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, action: insert, update, same or stored for each key; an update only if a field differs (null-safe)."""
    s = stored.select(*keys, F.struct(*fields).alias("__old"))
    n = staged.select(*keys, F.struct(*fields).alias("__new"))
    action = F.when(F.col("__old").isNull(), "insert").when(F.col("__new").isNull(), "stored").when(F.col("__old").eqNullSafe(F.col("__new")), "same").otherwise("update")
    return s.join(n, keys, "full").select(*keys, action.alias("action"))


def outside_windows(staged: DataFrame, windows: DataFrame, at: str, lo: str, hi: str, keys: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The staged rows outside every excluded window, and windows' columns and excluded: how many rows fell into each.

    Rows and windows meet by hour (and keys): a window is dealt to the hours it reaches into, a row to its own.
    """
    hour = F.date_trunc("hour", F.col(at)).alias("__hour")
    hours = F.explode(F.sequence(F.date_trunc("hour", F.col(lo)), F.date_trunc("hour", F.col(hi)), F.expr("interval 1 hour"))).alias("__hour")
    rows = staged.select("*", hour)
    w = windows.where(F.col(lo) < F.col(hi)).select("*", hours)
    inside = [rows["__hour"] == w["__hour"], *(rows[k] == w[k] for k in keys), rows[at] >= w[lo], rows[at] < w[hi]]
    counts = rows.join(w, inside).groupBy(*(w[c] for c in windows.columns)).agg(F.count("*").alias("excluded"))
    return rows.join(w, inside, "left_anti").drop("__hour"), counts


def keep_note(new: Column, old: Column, keep: Column) -> Column:
    """An operator's note: the old one stays where asked."""
    return F.when(keep, old).otherwise(new)
