"""Reads over networks, access points and channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import RANKS, choose, policy_reason, security_rank
from tidemark.operators import intervals
from tidemark.operators.stats import quantile


def local(at: Column, zone: str) -> Column:
    return F.from_utc_timestamp(at.cast("timestamp"), zone)


def network_rows(hourly: DataFrame, aps: DataFrame, zone: str) -> DataFrame:
    """A row for each network seen: access points, vendors, weakest level, whether all are random, hours, day hours (7 to 20 local) and days seen."""
    seen = hourly.join(aps, "ap")
    here = local(F.col("hour"), zone)
    day = F.hour(here).between(7, 19)
    presence = seen.select("network", "hour").distinct()
    presence = presence.groupBy("network").agg(F.count("*").alias("hours"), F.count_if(day).alias("day_hours"), F.count_distinct(F.when(day, F.to_date(here))).alias("days"))
    one = seen.dropDuplicates(["ap"]).withColumn("rank", F.coalesce(security_rank(F.col("level")), F.lit(99)))
    per = one.groupBy("network").agg(
        F.count("*").alias("bssids"), F.min("random").alias("randomized"), F.array_join(F.array_sort(F.collect_set("vendor")), ",").alias("vendors"), F.min("rank").alias("rank"),
    )
    names = {v: k for k, v in RANKS.items()}
    return per.join(presence, "network").withColumn("weakest", choose(F.col("rank"), names, "unknown")).drop("rank")


def verdicts(aps: DataFrame, networks: DataFrame) -> DataFrame:
    """aps of configured networks with the network's kind (net_kind) and, for managed ones, the reason why the policy is not met."""
    n = networks.select("network", F.col("kind").alias("net_kind"), "expected", "require_mfp")
    both = aps.join(F.broadcast(n) if n.limit(10_001).count() <= 10_000 else n, "network")
    reason = policy_reason(F.col("expected"), F.col("require_mfp"), F.col("kind"), F.col("required"))
    return both.withColumn("reason", F.when(F.col("net_kind") == "managed", reason))


def levels_in(seen: DataFrame, periods: DataFrame) -> DataFrame:
    """seen (bucket, ap, lo, hi) with rank: the weakest level of the access point's periods that the span meets; 99 for none."""
    met = intervals.overlapping(seen, periods.select("ap", "valid_from", "valid_to", "level"), ["ap"], ("lo", "hi"), ("valid_from", "valid_to"))
    rank = met.groupBy("bucket", "ap").agg(F.min(security_rank(F.col("level"))).alias("rank"))
    return seen.join(rank, ["bucket", "ap"], "left").withColumn("rank", F.coalesce("rank", F.lit(99)))


def primary(load: DataFrame, key: str, channel: str) -> DataFrame:
    """key, channel: the channel of most rows; ties go to the smaller one."""
    n = load.groupBy(key, channel).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.max_by(channel, F.struct(F.col("n"), -F.col(channel))).alias(channel))


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, q1, median, q3."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), quantile(value, 0.25).alias("q1"), quantile(value, 0.5).alias("median"), quantile(value, 0.75).alias("q3"))


def newest_each(df: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key in this order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")
