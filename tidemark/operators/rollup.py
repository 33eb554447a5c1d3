"""Rollups by entity and hour, and baselines, over censored readings. Rebuilding the touched hours equals rebuilding all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.stats import quantile


def hourly(df: DataFrame, entity: str, ts: str, reading: str, floor: Column, unit: str = "hour") -> DataFrame:
    """entity, hour, n_obs, n_valid, n_floor, median, p10, p90, low, high; floors are counted, never averaged."""
    r = df.select(entity, F.date_trunc(unit, ts).alias("hour"), floor.alias("__floor"), F.when(~floor, F.col(reading)).alias("__v"))
    return r.groupBy(entity, "hour").agg(
        F.count("*").alias("n_obs"), F.count("__v").alias("n_valid"), F.count_if("__floor").alias("n_floor"),
        quantile("__v", 0.5).alias("median"), quantile("__v", 0.1).alias("p10"), quantile("__v", 0.9).alias("p90"), F.min("__v").alias("low"), F.max("__v").alias("high"),
    )


def refreshed(rollup: DataFrame, df: DataFrame, since, entity: str, ts: str, reading: str, floor: Column) -> DataFrame:
    """A rollup after rows from `since` on were added or changed: hours before it are kept, the rest rebuilt."""
    hour = F.date_trunc("hour", F.lit(since).cast(df.schema[ts].dataType))
    return rollup.where(F.col("hour") < hour).unionByName(hourly(df.where(F.col(ts) >= hour), entity, ts, reading, floor))


def first_seen_per_hour(df: DataFrame, entity: str, ts: str) -> DataFrame:
    """hour, new_entities."""
    return df.groupBy(entity).agg(F.min(ts).alias("__t")).groupBy(F.date_trunc("hour", "__t").alias("hour")).agg(F.count("*").alias("new_entities"))


def baseline(df: DataFrame, entity: str, ts: str, reading: str, floor: Column, least_n: int, least_days: int) -> DataFrame:
    """entity, n_obs, n_floor, n_days, mean, sd, median, p5, p95, robust_sd of entities with enough readings on enough days."""
    r = df.select(entity, F.to_date(ts).alias("__day"), floor.alias("__floor"), F.when(~floor, F.col(reading)).alias("__v"))
    q = lambda p, name: quantile("__v", p).alias(name)
    base = r.groupBy(entity).agg(F.count("__v").alias("n_obs"), F.count_if("__floor").alias("n_floor"), F.count_distinct("__day").alias("n_days"), F.avg("__v").alias("mean"), F.stddev_pop("__v").alias("sd"), q(0.5, "median"), q(0.05, "p5"), q(0.95, "p95"))
    base = base.where((F.col("n_obs") >= least_n) & (F.col("n_days") >= least_days))
    away = r.where("__v is not null").join(base.select(entity, "median"), entity).withColumn("__away", F.abs(F.col("__v") - F.col("median")))
    return base.join(away.groupBy(entity).agg((quantile("__away", 0.5) * 1.4826).alias("robust_sd")), entity)


def presence_class(df: DataFrame, entity: str, ts: str, hours: int) -> DataFrame:
    """entity, hours, presence: permanent, regular, occasional or transient by the share of collecting hours."""
    h = df.groupBy(entity).agg(F.count_distinct(F.date_trunc("hour", ts)).alias("hours"))
    share = F.col("hours") / F.lit(hours)
    return h.withColumn("presence", F.when(F.col("hours") <= 2, "transient").when(share >= 0.9, "permanent").when(share >= 0.1, "regular").otherwise("occasional"))
