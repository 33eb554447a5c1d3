"""Calendar buckets in local time, coverage, and series with gaps where nothing was collected."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The periods that are shown, as bucket hours and number of buckets.
PERIODS = {"24h": (1, 24), "7d": (6, 28), "30d": (24, 30)}


def buckets(period: str, now: datetime, zone: str) -> list[tuple[datetime, datetime]]:
    """UTC [start, end) of each bucket, the last one holding now. Edges are local wall times, so a day of a clock change has 23 or 25 hours."""
    hours, n = PERIODS[period]
    local = now.astimezone(ZoneInfo(zone)).replace(minute=0, second=0, microsecond=0, tzinfo=None)
    if hours == 1:
        last = now.astimezone(timezone.utc).replace(minute=0, second=0, microsecond=0)
        edges = [last + timedelta(hours=i - n + 1) for i in range(n + 1)]
    else:
        last = local.replace(hour=local.hour // hours * hours)
        edges = [(last + timedelta(hours=hours * (i - n + 1))).replace(tzinfo=ZoneInfo(zone)).astimezone(timezone.utc) for i in range(n + 1)]
    return list(zip(edges, edges[1:], strict=False))


def bucket_of(at: Column, starts: list, end) -> Column:
    """Number (from 1) of the bucket that holds an instant, by its start; null outside."""
    kind = lambda x: F.lit(x).cast("timestamp")
    n = F.size(F.filter(F.array(*map(kind, starts)), lambda s: s <= at.cast("timestamp")))
    return F.when((n > 0) & (at.cast("timestamp") < kind(end)), n)


def hour_capture(polls: Column, captured: Column, span_s: Column, gap_s: Column) -> Column:
    """Seconds of an hour in which something was captured."""
    return F.when(polls > 0, F.greatest(span_s - gap_s, F.lit(0.0)) * captured / polls).otherwise(0.0)


def share(part_s: Column, total_s: Column, digits: int = 3) -> Column:
    """A coverage share in [0, 1]; 0 for no time."""
    return F.when(total_s > 0, F.round(F.least(F.lit(1.0), part_s / total_s), digits)).otherwise(0.0)


def masked(grid: DataFrame, series: DataFrame, on: list[str], values: list[str], collecting: str) -> DataFrame:
    """The whole grid with the series; 0 where nothing happened, null where nothing was collected."""
    joined = grid.join(series, on, "left")
    return joined.withColumns({v: F.when(F.col(collecting), F.coalesce(F.col(v), F.lit(0))) for v in values})


def grid(df: DataFrame, keys: list[str], lo: str, hi: str, step: str, name: str) -> DataFrame:
    """A row for each step between each row's lo and hi."""
    return df.select(*keys, F.explode(F.sequence(F.col(lo), F.col(hi), F.expr(f"interval {step}"))).alias(name))


def busiest_run(hourly: DataFrame, keys: list[str], hour: str, value: str, width: int = 4) -> DataFrame:
    """keys, start, load: the best `width` consecutive hours of the day, around midnight; ties go to the earlier start."""
    each = hourly.select(*keys, F.col(hour).alias("__h"), value, F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("__d"))
    runs = each.groupBy(*keys, F.pmod(F.col("__h") - F.col("__d"), F.lit(24)).alias("start")).agg(F.sum(value).alias("load"))
    return runs.groupBy(*keys).agg(F.max_by(F.struct("start", "load"), F.struct(F.col("load"), -F.col("start"))).alias("x")).select(*keys, "x.*")


def local_edges(spans: DataFrame, keys: list[str], lo: str, hi: str, zone: str, step: str) -> DataFrame:
    """keys, zone, place (from 1), edge (UTC): the local edges, `step` of wall time apart from a local midnight on, that cover [lo, hi]. lo, hi: instants in UTC; zone: a column of zone names. Around a change of the clocks a step is shorter or longer."""
    wall = lambda c: F.from_utc_timestamp(F.col(c).cast("timestamp"), F.col(zone))
    last = F.date_trunc("day", wall(hi)) + F.expr("interval 1 day")
    edges = F.sequence(F.date_trunc("day", wall(lo)), last, F.expr(f"interval {step}"))
    each = spans.select(*keys, zone, F.posexplode(edges).alias("__i", "__wall"))
    return each.select(*keys, zone, (F.col("__i") + 1).alias("place"), F.to_utc_timestamp("__wall", F.col(zone)).cast("timestamp_ntz").alias("edge"))


def bucket_by_edges(df: DataFrame, edges: DataFrame, keys: list[str], at: str) -> DataFrame:
    """df with bucket: the place of the last edge of its keys at or before `at`; null before the first and from the last on. edges: keys, place (1 to n), edge.

    The edges' span is cut into as many even cells as there are edges; a row looks at the edges of its own cell alone, and
    knows how many come before it.
    """
    at_us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    e = edges.select(*keys, "place", at_us("edge").alias("__e"))
    span = e.groupBy(*keys).agg(F.min("__e").alias("__lo"), F.max("__e").alias("__hi"), F.count("*").alias("__n"))
    cell = lambda x: F.floor((x - F.col("__lo")) / (F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1)) / F.col("__n")))
    full = e.join(F.broadcast(span), keys).groupBy(*keys, cell(F.col("__e")).alias("__cell")).agg(F.array_sort(F.collect_list("__e")).alias("__edges"), F.min("place").alias("__first"))
    cells = span.select(*keys, "__n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n"))).alias("__cell")).join(full, [*keys, "__cell"], "left")
    # cells without edges take over how many edges came before them: one row a cell
    before = Window.partitionBy(*keys).orderBy(F.desc("__cell")).rowsBetween(Window.unboundedPreceding, 0)
    known = cells.withColumn("__before", F.coalesce(F.last("__first", ignorenulls=True).over(before), F.col("__n") + 1) - 1).select(*keys, "__cell", "__before", "__edges")
    rows = df.join(F.broadcast(span), keys, "left").withColumn("__x", at_us(at)).withColumn("__cell", cell(F.col("__x")))
    out = rows.join(known, [*keys, "__cell"], "left")
    place = F.col("__before") + F.size(F.filter(F.coalesce("__edges", F.array().cast("array<bigint>")), lambda s: s <= F.col("__x")))
    inside = (F.col("__x") >= F.col("__lo")) & (F.col("__x") < F.col("__hi"))
    return out.select(*df.columns, F.when(inside, place).cast("long").alias("bucket"))
