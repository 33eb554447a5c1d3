"""Evidence, corroboration and audits of detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import micros
from tidemark.operators import intervals, series, stats
from tidemark.operators.stats import quantile


def burst_baseline(polls: DataFrame, keys: list[str], ts: str, tie: str, value: str, burst: Column, regular: tuple[float, float], poll_s: float) -> DataFrame:
    """keys, polls, bursts, active_hours, median and robust_sd of the value on regular polls (those whose distance to the one before lies inside `regular` seconds)."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    s = polls.withColumn("__s", (micros(ts) - F.lag(micros(ts)).over(w)) / 1e6)
    n = s.groupBy(*keys).agg(F.count("*").alias("polls"), F.count_if(burst).alias("bursts"), (F.count("*") * poll_s / 3600).alias("active_hours"))
    spread = stats.robust_spread(s.where(F.col("__s").between(*regular) & F.col(value).isNotNull()), keys, value)
    return n.join(spread, keys, "left")


def in_hardware_period(readings: DataFrame, periods: DataFrame) -> DataFrame:
    """readings with `same`: taken with the hardware of the entity's baseline (periods: ap, hw_from, hw_to; null is unbounded)."""
    r = readings.join(periods, "ap", "left")
    inside = (F.col("hw_from").isNull() | (F.col("ts") >= F.col("hw_from"))) & (F.col("hw_to").isNull() | (F.col("ts") < F.col("hw_to")))
    return r.withColumn("same", inside).drop("hw_from", "hw_to")


def corroborated(a: DataFrame, b: DataFrame, key: str, gap_s: int) -> tuple[DataFrame, DataFrame]:
    """a and b (id, key, first_at, last_at), each with `corroborated`: one of the other with the same key is at most gap_s away."""
    gap, tick = F.expr(f"interval {gap_s} seconds"), F.expr("interval 1 microsecond")
    x = a.select(key, F.col("id").alias("a"), F.col("first_at").alias("a_lo"), (F.col("last_at") + gap + tick).alias("a_hi"))
    y = b.select(key, F.col("id").alias("b"), F.col("first_at").alias("b_lo"), (F.col("last_at") + gap + tick).alias("b_hi"))
    met = intervals.overlapping(x, y, [key], ("a_lo", "a_hi"), ("b_lo", "b_hi"))
    mark = lambda df, side: df.join(met.select(F.col(side).alias("id")).distinct().withColumn("__c", F.lit(True)), "id", "left").withColumn("corroborated", F.coalesce("__c", F.lit(False))).drop("__c")
    return mark(a, "a"), mark(b, "b")


def unknown_members(devices: DataFrame, trusted: DataFrame) -> DataFrame:
    """devices (ap, network, vendor, kind) that advertise a trusted network without being trusted, with whether their vendor and kind are those of the trusted ones (kind: the most frequent; ties the smaller)."""
    v = trusted.select("network", "vendor", F.lit(True).alias("vendor_known")).distinct()
    k = trusted.groupBy("network", "kind").agg(F.count("*").alias("__n")).groupBy("network").agg(F.min_by("kind", F.struct(-F.col("__n"), "kind")).alias("dominant"))
    rest = devices.join(trusted.select("ap"), "ap", "left_anti").join(k, "network").join(v, ["network", "vendor"], "left")
    return rest.select("ap", "network", F.coalesce("vendor_known", F.lit(False)).alias("vendor_known"), (F.col("kind") == F.col("dominant")).alias("kind_matches"))


def split_audit(readings: DataFrame, split, k: float, floor_db: float, width: int) -> DataFrame:
    """variant, windows, entities: trailing medians of the readings from `split` on that leave a baseline by k robust deviations (floor_db at least).

    circular: the baseline is that of all readings; split: of those before `split` alone.
    """
    late = series.sliding_median_mad(readings.where(F.col("ts") >= split), ["ap"], ["ts", "id"], "level", width).where("win_median is not null")
    out = []
    for variant, base in (("circular", readings), ("split", readings.where(F.col("ts") < split))):
        b = stats.robust_spread(base, ["ap"], "level")
        away = F.abs(F.col("win_median") - F.col("median")) >= F.greatest(F.col("robust_sd") * k, F.lit(floor_db))
        out.append(late.join(b, "ap").where(away).agg(F.count("*").alias("windows"), F.count_distinct("ap").alias("entities")).select(F.lit(variant).alias("variant"), "windows", "entities"))
    return out[0].union(out[1])


def admissible(shares: DataFrame, share: str, bias: str, spread: str) -> DataFrame:
    """lo, hi: the largest share of floors up to which every bias stays within its spread (1 dB at least), and the smallest that breaks that. Entities are in order of their share."""
    bad = F.coalesce(F.col(bias) > F.greatest(F.coalesce(F.col(spread), F.lit(0.0)), F.lit(1.0)), F.lit(True))
    first = shares.agg(F.min(F.when(bad, F.col(share))).alias("__first"))
    both = shares.join(F.broadcast(first))
    return both.agg(
        F.coalesce(F.max(F.when(F.col("__first").isNull() | (F.col(share) < F.col("__first")), F.col(share))), F.lit(0.0)).alias("lo"), F.least(F.lit(0.5), F.coalesce(F.min("__first"), F.lit(0.5))).alias("hi"),
    )


def episode_rate(episodes: DataFrame, polls: DataFrame, keys: list[str], value: str, medians: DataFrame) -> DataFrame:
    """keys, episode, most, mean, ratio: the value's rate on the polls inside each episode, and the largest over the entity's median."""
    span = episodes.select(*keys, "episode", "first_at", (F.col("last_at") + F.expr("interval 1 microsecond")).alias("__end"))
    inside = intervals.points_inside(polls.select(*keys, F.col("ts").alias("__at"), value), span, keys, "__at", "first_at", "__end")
    n = inside.groupBy(*keys, "episode").agg(F.max(value).alias("most"), F.avg(value).alias("mean"))
    return n.join(medians, keys, "left").withColumn("ratio", F.try_divide("most", "median")).drop("median")


def recall(trials: DataFrame, by: list[str]) -> DataFrame:
    """by, n, hits, recall, low, high (Wilson), latency quantiles of trials with `hit` and `latency_s`."""
    from tidemark.functions.scalars import wilson

    out = trials.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), quantile("latency_s", 0.5, "hit").alias("median_s"), quantile("latency_s", 0.95, "hit").alias("p95_s"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return out.withColumns({"recall": F.col("hits") / F.col("n"), "low": low, "high": high})
