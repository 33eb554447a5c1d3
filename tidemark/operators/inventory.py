"""Impostor candidates among access points that advertise a protected name, and names that only look like one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import plain_name
from tidemark.operators import names
from tidemark.operators.stats import quantile

#: The flags, in order.
FLAGS = ("oui", "late", "strong", "crypt", "rand", "dropped", "adopted")


def protected_groups(aps: DataFrame, history: DataFrame, prefixes: DataFrame) -> DataFrame:
    """aps (ap, name, ...) of which the name, or one in their history (ap, name), begins with a protected prefix, whatever its case: with prefix (the first in `place`), dropped and has_history.

    prefixes: prefix, place; matched by heads of the prefixes' lengths, so names meet prefixes by an equi-join.
    """
    p = prefixes.select("prefix", "place", F.lower("prefix").alias("__p")).withColumn("__n", F.char_length("__p"))
    every = aps.select("ap", F.col("name").alias("s")).union(history.select("ap", "name")).where("s is not null").distinct()
    heads = every.join(F.broadcast(p.select("__n").distinct()), F.char_length("s") >= F.col("__n")).select("ap", "s", "__n", F.substring(F.lower("s"), F.lit(1), F.col("__n")).alias("__p"))
    hit = heads.join(p, ["__n", "__p"]).groupBy("ap").agg(F.min_by(F.struct("prefix", F.col("__p").alias("low")), "place").alias("x"))
    past = history.join(aps.select("ap", F.col("name").alias("__now")), "ap").where(F.col("name") != F.coalesce("__now", F.lit(""))).select("ap").distinct().withColumn("has_history", F.lit(True))
    out = aps.join(hit, "ap").join(past, "ap", "left")
    return out.select(*aps.columns, F.col("x.prefix").alias("prefix"), (~F.startswith(F.lower(F.coalesce("name", F.lit(""))), F.col("x.low"))).alias("dropped"), F.coalesce("has_history", F.lit(False)).alias("has_history"))


def protected_flags(groups: DataFrame, strong_db: float = 10.0) -> DataFrame:
    """groups (ap, prefix, oui, crypt, median, late, random, dropped, has_history) with a boolean for each of FLAGS.

    A group's own makers are those of most of its access points (ties: all of them), its encryption the most frequent one
    (ties: the smallest), its level the median of medians.
    """
    n = groups.groupBy("prefix", "oui").agg(F.count("*").alias("__n"))
    top = n.groupBy("prefix").agg(F.max("__n").alias("__n"))
    own = n.join(top, ["prefix", "__n"]).select("prefix", "oui", F.lit(True).alias("__own"))
    crypts = groups.where("crypt is not null").groupBy("prefix", "crypt").agg(F.count("*").alias("__n"))
    crypt = crypts.groupBy("prefix").agg(F.min_by("crypt", F.struct(-F.col("__n"), "crypt")).alias("__crypt"))
    level = groups.groupBy("prefix").agg(quantile("median", 0.5).alias("__level"), F.count("*").alias("__size"))
    g = groups.join(own, ["prefix", "oui"], "left").join(crypt, "prefix", "left").join(level, "prefix")
    sure = lambda c: F.coalesce(c, F.lit(False))
    flags: dict[str, Column] = {
        "oui": F.col("__own").isNull(), "late": sure(F.col("late")), "strong": sure((F.col("__size") > 1) & (F.col("median") >= F.col("__level") + strong_db)), "crypt": sure(F.col("crypt") != F.col("__crypt")), "rand": sure(F.col("random")),
        "dropped": F.col("has_history") & F.col("dropped"), "adopted": F.col("has_history") & ~F.col("dropped"),
    }
    return g.select("ap", "prefix", *(flags[f].alias(f"flag_{f}") for f in FLAGS))


def look_alikes(aps: DataFrame, groups: DataFrame, prefixes: DataFrame) -> DataFrame:
    """ap, name, prefix: access points outside of the groups whose plain name begins with a prefix's, or whose head is one edit from it; the first prefix of each."""
    rest = aps.where("name is not null and name <> ''").join(groups.select("ap"), "ap", "left_anti").withColumn("__plain", plain_name(F.col("name")))
    p = prefixes.withColumn("__prefix", plain_name(F.col("prefix")))
    pairs = names.heads_within_one_edit(rest, p, "__plain", "__prefix")
    found = rest.join(pairs, "__plain").join(p, "__prefix").groupBy("ap", "name").agg(F.min_by("prefix", "place").alias("prefix"))
    return found
