"""Windows in which a sensor's data are thrown away, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import intervals


def excluded_spans(windows: DataFrame, batches: DataFrame, now) -> DataFrame:
    """window, sensor, excl_from, excl_to: the time that each window excludes, widened to its first and last discarded rows; null: still on.

    windows: window, sensor, started_at, until, ended_at; batches: window, ts_from, ts_to.
    """
    b = batches.groupBy("window").agg(F.min("ts_from").alias("__from"), F.max("ts_to").alias("__to"))
    end = F.greatest(F.coalesce("ended_at", "until"), F.col("__to") + F.expr("interval 1 second"))
    on = F.col("ended_at").isNull() & (F.col("until") > now)
    return windows.join(b, "window", "left").select("window", "sensor", F.least("started_at", "__from").alias("excl_from"), F.when(~on, end).alias("excl_to"))


def closed(windows: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """The windows with those that have run out ended at their `until`, and an audit row for each of these."""
    due = F.col("ended_at").isNull() & (F.col("until") <= now)
    after = windows.withColumn("ended_at", F.when(due, F.col("until")).otherwise(F.col("ended_at")))
    return after, windows.where(due).select("window", "sensor", F.lit("discard expired").alias("action"), F.col("until").alias("at"))


def widened(spans: DataFrame, polls: DataFrame, keys: list[str], longest_s: int) -> DataFrame:
    """spans (lo, hi, a null hi is open) reaching to the neighbouring polls that are at most longest_s away."""
    ts = polls.select(*keys, "ts", F.col("ts").alias("poll"))
    before = intervals.asof(spans, ts, keys, "lo", "ts", ["poll"]).withColumnRenamed("poll", "__before")
    both = intervals.asof(before, ts, keys, "hi", "ts", ["poll"], forward=True).withColumnRenamed("poll", "__after")
    near = F.expr(f"interval {longest_s} seconds")
    lo = F.when(F.col("__before") >= F.col("lo") - near, F.col("__before")).otherwise(F.col("lo"))
    hi = F.when(F.col("__after") <= F.col("hi") + near, F.col("__after")).otherwise(F.col("hi"))
    return both.withColumns({"lo": lo, "hi": hi}).drop("__before", "__after")
