"""Rollups and one-row summaries of sensors and access points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import series
from tidemark.operators.stats import quantile


def hourly_levels(readings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, hour, n_obs, n_valid, n_floor, median of readings (ts, level, is_floor)."""
    r = readings.select(*keys, F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "level", "is_floor")
    return r.groupBy(*keys, "hour").agg(F.count("*").alias("n_obs"), F.count("level").alias("n_valid"), F.count_if("is_floor").alias("n_floor"), quantile("level", 0.5).alias("median"))


def sensor_hours(polls: DataFrame, hourly: DataFrame, alerts: DataFrame, longest_s: float = 90) -> DataFrame:
    """sensor, hour and its counts: polls, polls_ok, hop_ok, hop_known, capture, limited, gap_s, active, obs, new, alerts. An hour in which anything was counted has a row."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    n = lambda c, name: F.count_if(c).alias(name)
    p = polls.groupBy("sensor", hour).agg(F.count("*").alias("polls"), n(F.col("ok"), "polls_ok"), n(F.col("hop_ok"), "hop_ok"), F.count("hop_ok").alias("hop_known"), n(F.col("capture"), "capture"), n(F.col("limited"), "limited"))
    gaps = series.split_by_hour(series.gaps(polls, ["sensor"], "ts", "id", longest_s), "start_at", "end_at")
    g = gaps.groupBy("sensor", F.col("hour").cast("timestamp_ntz").alias("hour")).agg(F.sum("seconds_in_hour").alias("gap_s"))
    a = hourly.groupBy("sensor", "hour").agg(F.count("*").alias("active"), F.sum("n_obs").alias("obs"))
    first = hourly.groupBy("sensor", "ap").agg(F.min("hour").alias("hour")).groupBy("sensor", "hour").agg(F.count("*").alias("new"))
    al = alerts.groupBy("sensor", hour).agg(F.count("*").alias("alerts"))
    out = p
    for part in (g, a, first, al):
        out = out.join(part, ["sensor", "hour"], "full")
    return out.na.fill(0)


def hardware_periods(notes: DataFrame) -> DataFrame:
    """sensor, hw_from, hw_to: the time line of each sensor cut at its hardware changes; null is unbounded."""
    cuts = notes.where("kind = 'hardware_change'").select("sensor", F.col("starts_at").alias("at")).distinct()
    w = Window.partitionBy("sensor").orderBy("at")
    after = cuts.select("sensor", F.col("at").alias("hw_from"), F.lead("at").over(w).alias("hw_to"))
    first = cuts.groupBy("sensor").agg(F.min("at").alias("hw_to")).select("sensor", F.lit(None).cast("timestamp_ntz").alias("hw_from"), "hw_to")
    return after.union(first)


def known_bits(history: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """current with bits: its own, or the newest known ones (not 0) of the same text in the key's history. history: key, ts, text, bits; current: key, text, bits."""
    newest = history.where("bits <> 0").groupBy(key, "text").agg(F.max_by("bits", F.struct("ts", "bits")).alias("old"))
    h = newest.select(F.col(key).alias("__k"), F.col("text").alias("__t"), "old")
    both = current.join(h, (current[key] == h["__k"]) & current["text"].eqNullSafe(h["__t"]), "left")
    keep = (F.col("bits") != 0) | (F.col("text") == "Open")
    return both.select(key, "text", F.when(keep, F.col("bits")).otherwise(F.col("old")).alias("bits"))


def ap_summary(aps: DataFrame, hourly: DataFrame, readings: DataFrame, periods: DataFrame) -> DataFrame:
    """A row for each access point: its identity, readings counted and typical, and its security changes. Points without readings have zeros and nulls."""
    h = hourly.groupBy("ap").agg(F.sum("n_obs").alias("n_obs"), F.sum("n_valid").alias("n_valid"), F.sum("n_floor").alias("n_floor"), quantile("median", 0.5).alias("typical"), F.count_distinct("sensor").alias("sensors"))
    r = readings.groupBy("ap").agg(F.min("ts").alias("first_obs"), F.max("ts").alias("last_obs"))
    w = Window.partitionBy("ap").orderBy("valid_from")
    changed = periods.withColumn("before", F.lag("level").over(w)).where("before <> level")
    c = changed.groupBy("ap").agg(F.count("*").alias("n_changes"), F.max_by(F.concat_ws(">", "before", "level"), "valid_from").alias("last_change"), F.max("valid_from").alias("last_change_at"))
    out = aps.join(h, "ap", "left").join(r, "ap", "left").join(c, "ap", "left")
    return out.na.fill(0, ["n_obs", "n_valid", "n_floor", "n_changes", "sensors"])


def sensor_summary(polls: DataFrame, hourly: DataFrame, notes: DataFrame, longest_s: float) -> DataFrame:
    """A row for each sensor: polls, their span, share that is ok, gaps and their seconds, the longest, access points, the last capture, open notes."""
    p = polls.groupBy("sensor").agg(
        F.count("*").alias("polls"), F.count_if("ok").alias("polls_ok"), F.min("ts").alias("first_poll"), F.max("ts").alias("last_poll"), F.max(F.when(F.col("capture"), F.col("ts"))).alias("last_capture"),
    )
    g = series.gaps(polls, ["sensor"], "ts", "id", longest_s).groupBy("sensor").agg(F.count("*").alias("gaps"), F.sum("seconds").alias("gap_s"), F.max("seconds").alias("longest_s"))
    a = hourly.groupBy("sensor").agg(F.count_distinct("ap").alias("aps"))
    n = notes.groupBy("sensor").agg(F.count_if(F.col("ends_at").isNull()).alias("open_notes"))
    return p.join(g, "sensor", "left").join(a, "sensor", "left").join(n, "sensor", "left").na.fill(0)


def newest_of(rows: DataFrame, key: str, at: str, tie: str, fields: list[str]) -> DataFrame:
    """key and the fields of its newest row (ties: the larger `tie`)."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(at, tie)).alias("x")).select(key, "x.*")


def sampled(df: DataFrame, keys: list[str], number: str, k: int, seed: str) -> DataFrame:
    """k rows of each key without replacement, by a keyed digest of their number; the same each time."""
    draw = F.md5(F.concat_ws(":", F.lit(seed), F.col(number).cast("string")))
    return series.top_each(df.withColumn("__draw", draw), keys, ["__draw", number], k).drop("__draw")


def quartile_share(df: DataFrame, keys: list[str], value: str, limits: tuple[float, ...]) -> DataFrame:
    """keys, n, q1, median, q3 and the share of values within each limit."""
    within = lambda x: (F.count_if(F.col(value) <= x) / F.count(value)).alias(f"within_{int(x)}")
    return df.groupBy(*keys).agg(F.count(value).alias("n"), quantile(value, 0.25).alias("q1"), quantile(value, 0.5).alias("median"), quantile(value, 0.75).alias("q3"), *map(within, limits))


def concatenated(label: Column, order: Column) -> Column:
    """Labels in order, joined by semicolons; null for none."""
    texts = F.transform(F.array_sort(F.collect_list(F.when(label.isNotNull(), F.struct(order, label.alias("t"))))), lambda x: x["t"])
    return F.when(F.count(label) > 0, F.array_join(texts, "; "))
