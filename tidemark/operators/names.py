"""Similar names without comparing all pairs: names within an edit share a name with letters left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deletions(name: Column) -> Column:
    """The name, and the name without each one of its characters."""
    n = F.char_length(name)
    without = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, n)))
    return F.array_distinct(F.concat(F.array(name), without))


def within_one_edit(a: DataFrame, b: DataFrame, a_name: str, b_name: str) -> DataFrame:
    """Distinct pairs (a_name, b_name) of names at most one insertion, deletion or replacement apart.

    Two such names have a member of their deletion neighbourhoods in common, so they meet in an equi-join of (length + 1) rows
    a name; what meets is checked. Column names must differ.
    """
    x = a.select(a_name).where(F.col(a_name).isNotNull()).distinct().withColumn("__d", F.explode(deletions(F.col(a_name))))
    y = b.select(b_name).where(F.col(b_name).isNotNull()).distinct().withColumn("__d", F.explode(deletions(F.col(b_name))))
    return x.join(y, "__d").where(F.levenshtein(F.col(a_name), F.col(b_name)) <= 1).select(a_name, b_name).distinct()


def heads_within_one_edit(names: DataFrame, prefixes: DataFrame, name: str, prefix: str, least: int = 3, least_edit: int = 4) -> DataFrame:
    """Distinct pairs (name, prefix) where the name begins with the prefix (of `least` characters or more), or its head of the prefix's length is one edit from it (of `least_edit` or more)."""
    p = prefixes.select(prefix).distinct().withColumn("__n", F.char_length(prefix)).where(F.col("__n") >= least)
    n = names.select(name).where(F.col(name).isNotNull()).distinct()
    lengths = p.select("__n").distinct()  # as many as prefixes have lengths
    heads = n.join(F.broadcast(lengths), F.char_length(name) >= F.col("__n") - 1).select(name, "__n", F.substring(F.col(name), F.lit(1), F.col("__n")).alias("__head"))
    x = heads.withColumn("__d", F.explode(deletions(F.col("__head"))))
    y = p.withColumn("__d", F.explode(deletions(F.col(prefix))))
    near = F.levenshtein(F.col("__head"), F.col(prefix))
    return x.join(y, ["__n", "__d"]).where((near == 0) | ((F.col("__n") >= least_edit) & (near <= 1))).select(name, prefix).distinct()
