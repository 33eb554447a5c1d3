"""Operators over half-open intervals [lo, hi); a null end is open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import micros


def merged(df: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """keys, lo, hi, n: overlapping and abutting intervals as one; open if one of them is. A row without both ends covers no time: it counts to its keys' last interval, or stands alone if there is none."""
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(lo), F.col(hi).isNull(), hi)
    end = F.when(F.coalesce(lo, hi).isNotNull(), F.struct(F.col(hi).isNull().alias("open"), F.col(hi).alias("at")))
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = df.withColumn("__new", F.coalesce(~reach["open"] & (F.col(lo) > reach["at"]), reach.isNull()).cast("int"))
    run = new.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = run.groupBy(*keys, "__run").agg(F.min(lo).alias(lo), F.max(end).alias("__end"), F.count("*").alias("n"))
    return out.select(*keys, lo, F.col("__end.at").alias(hi), "n")


def overlap_seconds(a_lo, a_hi, b_lo, b_hi) -> Column:
    """Seconds that two intervals share; null if both are open."""
    shared = F.greatest((F.least(micros(a_hi), micros(b_hi)) - F.greatest(micros(a_lo), micros(b_lo))) / 1e6, F.lit(0.0))
    return F.when(micros(a_hi).isNotNull() | micros(b_hi).isNotNull(), shared)


_HOUR = 3_600_000_000


def _grain(lo: str, hi: str) -> Column:
    """The least power of two that makes as many hours at least as long as the interval; null if it is open or empty."""
    return F.when(F.col(hi) > F.col(lo), F.greatest(F.ceil(F.log2((micros(hi) - micros(lo)) / _HOUR)), F.lit(0)).cast("int"))


def _grains(spans: DataFrame, lo: str, hi: str) -> tuple[list[int], bool]:
    """The grains that occur (a century has 20), and whether there are open intervals."""
    found = spans.select(_grain(lo, hi).alias("g"), F.col(hi).isNull().alias("open")).distinct().collect()
    return sorted(r["g"] for r in found if r["g"] is not None), any(r["open"] for r in found)


def _bucket(us: Column, grain: Column | int) -> Column:
    return F.floor(us / (F.pow(F.lit(2.0), grain) * _HOUR))


def _dealt(spans: DataFrame, lo: str, hi: str) -> DataFrame:
    """The closed intervals with __g, once for each __b, a bucket of their grain, that they reach into: one or two. Not broadcast, since Spark does not see that rows multiply here."""
    closed = spans.withColumn("__g", _grain(lo, hi)).where("__g is not null")
    reach = F.sequence(_bucket(micros(lo), F.col("__g")), _bucket(micros(hi) - 1, F.col("__g")))
    return closed.withColumn("__b", F.explode(reach)).hint("merge")


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], a_span: tuple[str, str], b_span: tuple[str, str]) -> DataFrame:
    """Pairs of a and b of equal keys whose intervals overlap.

    Two intervals overlap if one begins inside the other, so a pair is found once, as a point in an interval: b's begin in a,
    or a's later begin in b. Other columns must have different names.
    """
    order = [*keys, *(c for c in a.columns if c not in keys), *(c for c in b.columns if c not in keys)]
    begins = points_inside(b, a, keys, b_span[0], *a_span).select(*order)
    later = points_inside(a, b, keys, a_span[0], *b_span).where(F.col(a_span[0]) > F.col(b_span[0])).select(*order)
    before = lambda x, y: F.coalesce(F.col(x) < F.col(y), F.lit(True))
    return begins.union(later).where(before(a_span[0], b_span[1]) & before(b_span[0], a_span[1]))


def points_inside(points: DataFrame, spans: DataFrame, keys: list[str], at: str, lo: str, hi: str) -> DataFrame:
    """Pairs of a point and an interval of equal keys with lo <= at < hi, dealt by key and bucket of the interval's grain; open intervals, as a rule one a key, by key."""
    grains, some_open = _grains(spans, lo, hi)
    x = points.withColumn("__g", F.explode(F.array(*map(F.lit, grains or [0])))).withColumn("__b", _bucket(micros(at), F.col("__g")))
    closed = x.join(_dealt(spans, lo, hi), [*keys, "__g", "__b"]).where((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("__g", "__b")
    if not some_open:
        return closed
    return closed.unionByName(points.join(spans.where(F.col(hi).isNull()), keys).where(F.col(at) >= F.col(lo)))


def points_outside(points: DataFrame, spans: DataFrame, keys: list[str], at: str, lo: str, hi: str) -> DataFrame:
    """The points that no interval of equal keys covers, grain by grain."""
    grains, some_open = _grains(spans, lo, hi)
    own = [f"__k{i}" for i in range(len(keys))]
    same = [F.col(k) == F.col(o) for k, o in zip(keys, own, strict=True)]
    named = spans.select(*(F.col(k).alias(o) for k, o in zip(keys, own, strict=True)), F.col(lo).alias("__lo"), F.col(hi).alias("__hi"))
    rest = points
    for g in grains:
        y = _dealt(named, "__lo", "__hi").where(F.col("__g") == g)
        rest = rest.withColumn("__at", _bucket(micros(at), F.lit(g))).join(y, [*same, F.col("__at") == F.col("__b"), F.col(at) >= F.col("__lo"), F.col(at) < F.col("__hi")], "left_anti").drop("__at")
    if some_open:
        since = named.where("__hi is null").groupBy(*own).agg(F.min("__lo").alias("__since"))
        rest = rest.join(since, [*same, F.col(at) >= F.col("__since")], "left_anti")
    return rest


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, values: list[str], forward: bool = False) -> DataFrame:
    """left with the values of the last right row at or before `at` (forward: the first after it). One window over the union."""
    kept = [c for c in left.columns if c not in keys]
    row = F.struct(*kept).alias("__row")
    a = left.select(*keys, F.col(at).alias("__at"), F.lit(1 if not forward else 0).alias("__side"), row)
    b = right.select(*keys, F.col(right_at).alias("__at"), F.lit(0 if not forward else -1).alias("__side"), F.struct(*(F.col(v) for v in values)).alias("__v"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("__at", "__side")
    if forward:
        w = Window.partitionBy(*keys).orderBy(F.desc("__at"), F.desc("__side"))
    found = both.withColumn("__v", F.last("__v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return found.where(F.col("__row").isNotNull()).select(*keys, "__row.*", *(F.col(f"__v.{v}").alias(v) for v in values))
