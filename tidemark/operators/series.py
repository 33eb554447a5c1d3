"""Operators over event series: gaps, episodes, states, sliding windows. All windows are partitioned by the entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import micros


def _by(keys, *order):
    return Window.partitionBy(*keys).orderBy(*order)


def gaps(df: DataFrame, keys: list[str], ts: str, tie: str, longer_s: float) -> DataFrame:
    """keys, start_at, end_at, seconds: silences of more than `longer_s` between neighbours."""
    before = F.lag(ts).over(_by(keys, ts, tie))
    out = df.select(*keys, before.alias("start_at"), F.col(ts).alias("end_at"))
    seconds = (micros("end_at") - micros("start_at")) / 1e6
    return out.withColumn("seconds", seconds).where(F.col("seconds") > longer_s)


def split_by_hour(spans: DataFrame, start: str, end: str) -> DataFrame:
    """Each span once for each hour that it reaches into: hour, seconds_in_hour."""
    hours = F.explode(F.sequence(F.date_trunc("hour", start).cast("timestamp"), F.col(end).cast("timestamp"), F.expr("interval 1 hour"))).alias("hour")
    each = spans.select("*", hours)
    lo = F.greatest(micros(start), micros("hour"))
    hi = F.least(micros(end), micros("hour") + 3_600_000_000)
    return each.withColumn("seconds_in_hour", (hi - lo) / 1e6).where("seconds_in_hour > 0")


def islands(df: DataFrame, keys: list[str], order: list[str], new: Column, name: str = "island") -> DataFrame:
    """df with the running number of its island; `new`: true where one begins."""
    w = _by(keys, *order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(new, 1).otherwise(0)).over(w))


def sessionize(df: DataFrame, keys: list[str], ts: str, tie: str, gap_s: float, name: str = "episode") -> DataFrame:
    """df with the running number of its episode; a silence of more than gap_s ends one."""
    w = _by(keys, ts, tie)
    away = micros(ts) - F.lag(micros(ts)).over(w)
    marked = df.withColumn("__new", F.coalesce(away > int(gap_s * 1e6), F.lit(False)))
    return islands(marked, keys, [ts, tie], F.col("__new"), name).drop("__new")


def episodes(df: DataFrame, keys: list[str], ts: str, tie: str, gap_s: float, *aggregates: Column) -> DataFrame:
    """keys, episode, first_at, last_at, n, seconds and the aggregates of each episode."""
    e = sessionize(df, keys, ts, tie, gap_s).groupBy(*keys, "episode")
    out = e.agg(F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), F.count("*").alias("n"), *aggregates)
    return out.withColumn("seconds", (micros("last_at") - micros("first_at")) / 1e6)


def state_periods(df: DataFrame, keys: list[str], ts: str, tie: str, state: str, longest_s: float) -> DataFrame:
    """keys, state, from_at, to_at (null: still open), n: runs of one state; an interval longer than longest_s to the next row is an outage."""
    w = _by(keys, ts, tie)
    nxt = df.withColumn("__next", F.lead(ts).over(w))
    away = (micros("__next") - micros(ts)) / 1e6
    held = nxt.withColumn("__state", F.when(away > longest_s, F.lit("outage")).otherwise(F.col(state)))
    changed = held.withColumn("__new", ~F.col("__state").eqNullSafe(F.lag("__state").over(w)))
    runs = islands(changed, keys, [ts, tie], F.col("__new"), "__run")
    open_end = F.max(F.col("__next").isNull())
    out = runs.groupBy(*keys, "__run").agg(F.first("__state").alias("state"), F.min(ts).alias("from_at"), F.when(~open_end, F.max("__next")).alias("to_at"), F.count("*").alias("n"))
    return out.drop("__run")


def run_lengths(df: DataFrame, keys: list[str], order: list[str], flag: Column) -> DataFrame:
    """keys, length, runs: how many runs of true flags there are of each length."""
    every, own = _by(keys, *order), Window.partitionBy(*keys, "__flag").orderBy(*order)
    marked = df.withColumn("__flag", flag)
    at = marked.withColumn("__run", F.row_number().over(every) - F.row_number().over(own)).where("__flag")
    return at.groupBy(*keys, "__run").agg(F.count("*").alias("length")).groupBy(*keys, "length").agg(F.count("*").alias("runs"))


def sliding_median_mad(df: DataFrame, keys: list[str], order: list[str], value: str, width: int) -> DataFrame:
    """df with win_median and win_mad of the last `width` values; null until there are so many."""
    w = _by(keys, *order).rowsBetween(-(width - 1), 0)
    lo, hi = (width - 1) // 2, width // 2
    middle = lambda a: (F.get(a, F.lit(lo)) + F.get(a, F.lit(hi))) / 2
    held = df.withColumn("__win", F.array_sort(F.collect_list(F.col(value).cast("double")).over(w)))
    held = held.withColumn("win_median", F.when(F.size("__win") == width, middle(F.col("__win"))))
    away = F.array_sort(F.transform("__win", lambda x: F.abs(x - F.col("win_median"))))
    return held.withColumn("win_mad", F.when(F.col("win_median").isNotNull(), middle(away))).drop("__win")


def most_in_span(df: DataFrame, keys: list[str], ts: str, span_s: float) -> DataFrame:
    """keys, most: the largest number of rows within span_s, both ends included."""
    w = Window.partitionBy(*keys).orderBy("__us").rangeBetween(-int(span_s * 1e6), 0)
    return df.withColumn("__us", micros(ts)).withColumn("__n", F.count("*").over(w)).groupBy(*keys).agg(F.max("__n").alias("most"))


def counter_steps(df: DataFrame, keys: list[str], order: list[str], number: str, modulus: int) -> DataFrame:
    """df with step: the distance to the number before, modulo `modulus`."""
    return df.withColumn("step", F.pmod(F.col(number) - F.lag(number).over(_by(keys, *order)), F.lit(modulus)))


def id_ranges(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """keys, first, last: whole numbers as ranges without holes."""
    d = df.select(*keys, number).distinct()
    at = d.withColumn("__run", F.col(number) - F.row_number().over(_by(keys, number)))
    return at.groupBy(*keys, "__run").agg(F.min(number).alias("first"), F.max(number).alias("last")).drop("__run")


def train_test(df: DataFrame, keys: list[str], order: list[str], share: float) -> DataFrame:
    """df with in_train: the first share of each key's rows, rounded down."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("in_train", F.row_number().over(_by(keys, *order)) <= F.floor(n * share))


def top_each(df: DataFrame, keys: list[str], order: list, k: int = 1) -> DataFrame:
    """The first k rows of each key in this order."""
    return df.withColumn("__n", F.row_number().over(_by(keys, *order))).where(F.col("__n") <= k).drop("__n")


def interpolated(samples: DataFrame, at: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """at with value: linear between the samples around each instant; null outside."""
    s = samples.select(*keys, micros(ts).alias("__us"), F.col(value).cast("double").alias("__v"), F.lit(0).alias("__q"))
    cols = [c for c in at.columns if c not in keys]
    q = at.select(*keys, micros(ts).alias("__us"), F.lit(None).cast("double").alias("__v"), F.lit(1).alias("__q"), F.struct(*cols).alias("__row"))
    both = s.withColumn("__row", F.lit(None).cast(q.schema["__row"].dataType)).unionByName(q)
    pair = F.when(F.col("__v").isNotNull(), F.struct("__us", "__v"))
    w = Window.partitionBy(*keys).orderBy("__us", "__q")
    back = F.last(pair, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(pair, ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__us", F.desc("__q")).rowsBetween(0, Window.unboundedFollowing))
    out = both.withColumns({"__a": back, "__b": ahead}).where("__q = 1")
    share = (F.col("__us") - F.col("__a.__us")) / (F.col("__b.__us") - F.col("__a.__us"))
    v = F.when(F.col("__a.__us") == F.col("__b.__us"), F.col("__a.__v")).otherwise(F.col("__a.__v") + share * (F.col("__b.__v") - F.col("__a.__v")))
    return out.select(*keys, "__row.*", v.alias("value"))
