"""Exact statistics: robust spread, describe, mode, entropy, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantile(value: str, p: float, where: str | None = None) -> Column:
    """An exact, interpolated quantile, of the rows that meet a condition."""
    f = f" filter (where {where})" if where else ""
    return F.expr(f"percentile_cont({p}) within group (order by {value}){f}")


def robust_spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, median, robust_sd (1.4826 times the median distance from the median)."""
    mid = df.groupBy(*keys).agg(quantile(value, 0.5).alias("median"))
    away = df.join(mid, keys).withColumn("__away", F.abs(F.col(value) - F.col("median")))
    return away.groupBy(*keys, "median").agg((quantile("__away", 0.5) * 1.4826).alias("robust_sd"))


def describe(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, mean, median, p10, p90, low, high."""
    q = lambda p, name: quantile(value, p).alias(name)
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), q(0.5, "median"), q(0.1, "p10"), q(0.9, "p90"), F.min(value).alias("low"), F.max(value).alias("high"))


def mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, n: the most frequent value; ties go to the smallest."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), value)
    return n.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def entropy(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, bits: Shannon entropy of the values' shares."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    return n.withColumn("p", share).groupBy(*keys).agg(F.sum(-F.col("p") * F.log2("p")).alias("bits"))


def weighted_mean(total: str, count: str) -> Column:
    """sum(total) / sum(count); null for no count."""
    return F.try_divide(F.sum(total), F.sum(count))


def exceedance(df: DataFrame, keys: list[str], value: str, centre: str, limits: list[float]) -> DataFrame:
    """keys, threshold, n, above, share: how often |value - centre| reaches each threshold. One pass, a column a threshold."""
    away = F.abs(F.col(value) - F.col(centre))
    wide = df.groupBy(*keys).agg(F.count(value).alias("n"), *(F.count(F.when(away >= t, 1)).alias(f"t{i}") for i, t in enumerate(limits)))
    rows = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("above")) for i, t in enumerate(limits)))).alias("x")
    return wide.select(*keys, "n", rows).select(*keys, "x.threshold", "n", "x.above", (F.col("x.above") / F.col("n")).alias("share"))
