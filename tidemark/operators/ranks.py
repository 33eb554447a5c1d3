"""Places of rows in an order, without a task that sees all of them: counts before an instant, exact quantiles, pages.

The common step: rows are dealt into ranges of the order (blocks of time, or range partitions), counted a range, and a
row's place is its place inside of its range plus the counts of the ranges before it. What is added up over ranges is one
row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import micros
from tidemark.operators import intervals
from tidemark.session import kept


def points_between(spans: DataFrame, points: DataFrame, keys: list[str], span_id: str, lo: str, hi: str, ts: str, unit: str = "day") -> DataFrame:
    """span_id, n: how many points of equal keys lie in lo <= ts <= hi. Two lookups a span in running counts, no pairs."""
    side = lambda at, sign: F.struct(F.col(at).alias("at"), F.lit(sign).alias("sign"))
    ends = spans.select(*keys, F.col(span_id).alias("__id"), F.inline(F.array(side(lo, -1), side(hi, 1))))
    both = points.select(*keys, F.lit(None).cast(spans.schema[span_id].dataType).alias("__id"), F.col(ts).alias("at"), F.lit(0).alias("sign")).unionByName(ends)
    both = both.withColumn("__block", F.date_trunc(unit, "at")).withColumn("__one", (F.col("sign") == 0).cast("long"))
    w = Window.partitionBy(*keys, "__block").orderBy("at", "sign").rowsBetween(Window.unboundedPreceding, 0)  # a span's begin before, its end after the points of its instant
    inside = both.withColumn("__n", F.sum("__one").over(w)).where("sign <> 0")
    sums = both.groupBy(*keys, "__block").agg(F.sum("__one").alias("__sum"))
    before = sums.withColumn("__sum", F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__block")) - F.col("__sum"))
    return inside.join(before, [*keys, "__block"]).groupBy(F.col("__id").alias(span_id)).agg(F.sum(F.col("sign") * (F.col("__n") + F.col("__sum"))).alias("n"))


def seen_in_windows(windows: DataFrame, points: DataFrame, keys: list[str], span_id: str, lo: str, length_s: float, ts: str, member: str, counts: dict[str, Column]) -> DataFrame:
    """span_id, members: how many different members of equal keys have a point with lo <= ts < lo + length_s, and for each name of `counts` at how many points, with a member or without, it holds.

    A member's first point in a window is the one whose window begins after the member's point before, and after ts - length_s,
    but not after ts. So members and points are running sums over time, looked up at a window's begin and end, without pairs.
    An id of several windows counts a member once; its members are met in pairs.
    """
    length, names = int(length_s * 1e6), ["members", *counts]
    long = lambda c, name: c.cast("long").alias(name)
    p = points.dropna(subset=[*keys, ts]).select(*keys, member, micros(ts).alias("__us"), *(long(F.coalesce(c, F.lit(False)), n) for n, c in counts.items()))
    known = F.col(member).isNotNull()
    of_member = Window.partitionBy(*keys, member, F.when(~known, F.floor(F.col("__us") / 3_600_000_000))).orderBy("__us")  # points without a member are no history
    opens = F.greatest(F.lag("__us").over(of_member), F.col("__us") - length)
    step = lambda at, one, held: F.struct(F.col(at).alias("__at"), long(one, "members"), *(long(F.col(n) if held else F.lit(0), n) for n in counts))
    steps = p.withColumn("__opens", opens).select(*keys, F.lit(None).cast(windows.schema[span_id].dataType).alias("__id"), F.lit(0).alias("__sign"), F.inline(F.array(step("__opens", known.cast("long"), False), step("__us", -known.cast("long"), True))))
    ends = [F.struct(micros(lo).alias("__at"), F.lit(-1).alias("__sign")), *([F.struct((micros(lo) + length).alias("__at"), F.lit(1).alias("__sign"))] if counts else [])]
    asks = windows.select(*keys, F.col(span_id).alias("__id"), F.inline(F.array(*ends))).select("*", *(long(F.lit(0), n) for n in names))
    both = steps.unionByName(asks).withColumn("__block", F.floor(F.col("__at") / 3_600_000_000))
    w = Window.partitionBy(*keys, "__block").orderBy("__at", F.col("__sign") == 0).rowsBetween(Window.unboundedPreceding, 0)  # asked before the steps of an instant
    inside = both.withColumns({f"__n_{n}": F.sum(n).over(w) for n in names}).where("__sign <> 0")
    sums = both.groupBy(*keys, "__block").agg(*(F.sum(n).alias(n) for n in names))
    so_far = Window.partitionBy(*keys).orderBy("__block")  # one row an hour
    before = sums.select(*keys, "__block", *((F.sum(n).over(so_far) - F.col(n)).alias(f"__b_{n}") for n in names))
    at = lambda n: F.col(f"__n_{n}") + F.coalesce(f"__b_{n}", F.lit(0))
    found = inside.drop(*names).join(before, [*keys, "__block"], "left")
    out = found.groupBy(F.col("__id").alias(span_id)).agg(F.sum(F.when(F.col("__sign") < 0, at("members")).otherwise(0)).alias("members"), *(F.sum(F.col("__sign") * at(n)).alias(n) for n in counts))
    several = windows.groupBy(F.col(span_id).alias("__id")).count().where("count > 1").select("__id")
    if several.isEmpty():
        return out
    theirs = windows.join(several, F.col(span_id).eqNullSafe(F.col("__id")), "left_semi").dropna(subset=[*keys, lo])
    spans = theirs.select(*keys, F.col(span_id).alias("__id"), F.col(lo).alias("__lo"), (F.col(lo) + F.expr(f"interval {length} microseconds")).alias("__hi"))
    spans = intervals.merged(spans, ["__id", *keys], "__lo", "__hi").drop("n")
    seen = intervals.points_inside(points.where(known).select(*keys, F.col(member).alias("__member"), F.col(ts).alias("__at")), spans, keys, "__at", "__lo", "__hi")
    seen = seen.groupBy("__id").agg(F.count_distinct("__member").alias("__members"))
    both = out.join(seen, F.col(span_id).eqNullSafe(F.col("__id")), "left").withColumn("members", F.coalesce("__members", "members"))
    return both.drop("__id", "__members")


def next_rows(left: DataFrame, right: DataFrame, keys: list[str], since: str, at: str, tie: str, n: int, unit: str = "hour") -> DataFrame:
    """left with the first n rows of right, in order of time and tie, that are not before left's own time; joined by their places. Other columns must have different names."""
    a = left.where(F.col(since).isNotNull()).select(*keys, F.col(since).alias("__at"), F.struct(*(c for c in left.columns if c not in keys)).alias("__a"))
    b = right.where(F.col(at).isNotNull()).select(*keys, F.col(at).alias("__at"), F.col(tie).alias("__tie"), F.struct(*(c for c in right.columns if c not in keys)).alias("__b"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__block", F.date_trunc(unit, "__at")).withColumn("__one", F.col("__b").isNotNull().cast("long"))
    w = Window.partitionBy(*keys, "__block").orderBy("__at", "__one", "__tie").rowsBetween(Window.unboundedPreceding, 0)  # left before right's rows of its instant
    sums = both.groupBy(*keys, "__block").agg(F.sum("__one").alias("__sum"))
    before = sums.withColumn("__sum", F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__block")) - F.col("__sum"))  # one row a block
    placed = both.withColumn("__n", F.sum("__one").over(w)).join(before, [*keys, "__block"]).withColumn("__place", F.col("__n") + F.col("__sum"))
    asked = placed.where("__one = 0").select(*keys, "__a", F.explode(F.sequence(F.col("__place") + 1, F.col("__place") + n)).alias("__place"))
    return asked.join(placed.where("__one = 1").select(*keys, "__place", "__b"), [*keys, "__place"]).select(*keys, "__a.*", "__b.*")


def _ranged(df: DataFrame, by: list, name: str, parts: int | None) -> DataFrame:
    """df in ranges of an order, written with the number of each row's range."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept(df.repartitionByRange(n, *by).withColumn("__part", F.spark_partition_id()), name)


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], parts: int | None = None) -> DataFrame:
    """keys, n and an exact, interpolated quantile for each name of `shares`; of a few groups of any size.

    Equal values are counted first. The distinct ones are dealt into ranges of (keys, value), so that a group's values are
    spread over as many tasks as it takes, and the two values around each quantile are picked by their places.
    """
    counted = kept(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__c")), "counted")
    ranged = _ranged(counted, [*keys, "__v"], "ranged", parts)
    group = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"__k{i}") for i, k in enumerate(keys)] + [F.col(k).isNull().alias(f"__null{i}") for i, k in enumerate(keys)]
    names = [f"__k{i}" for i in range(len(keys))] + [f"__null{i}" for i in range(len(keys))]
    r = ranged.select("*", *group)
    sums = r.groupBy(*names, "__part").agg(F.sum("__c").alias("__sum"))
    of_group = Window.partitionBy(*names)  # one row a range
    sums = sums.select(*names, "__part", (F.sum("__sum").over(of_group.orderBy("__part")) - F.col("__sum")).alias("__before"), F.sum("__sum").over(of_group).alias("n"))
    run = Window.partitionBy(*names, "__part").orderBy("__v")
    at = r.withColumn("__end", F.sum("__c").over(run)).join(sums, [*names, "__part"])
    at = at.withColumns({"__end": F.col("__end") + F.col("__before"), "__start": F.col("__end") + F.col("__before") - F.col("__c")})
    holds = lambda place: (F.col("__start") <= place) & (place < F.col("__end"))
    lower = {c: F.floor((F.col("n") - 1) * p) for c, p in shares.items()}
    upper = {c: F.ceil((F.col("n") - 1) * p) for c, p in shares.items()}
    wanted = F.lit(False)
    for c in shares:
        wanted = wanted | holds(lower[c]) | holds(upper[c])
    picked = at.where(wanted).groupBy(*names, "n").agg(*(F.first(k).alias(k) for k in keys), *(F.max(F.when(holds(lower[c]), F.col("__v"))).alias(f"__lo_{c}") for c in shares), *(F.max(F.when(holds(upper[c]), F.col("__v"))).alias(f"__hi_{c}") for c in shares))
    part = lambda c, p: (F.col("n") - 1) * p - lower[c]
    between = (F.when(F.col(f"__lo_{c}") == F.col(f"__hi_{c}"), F.col(f"__lo_{c}")).otherwise(F.col(f"__lo_{c}") * (1 - part(c, p)) + F.col(f"__hi_{c}") * part(c, p)).alias(c) for c, p in shares.items())
    return picked.select(*keys, "n", *between)


def numbered(df: DataFrame, order: list, parts: int | None = None) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """df with its range __part, and each range's first place (from 1) and rows, which is one pair a range."""
    rows = _ranged(df, order, "numbered", parts)
    counts = sorted((r["__part"], r["count"]) for r in rows.groupBy("__part").count().collect())
    starts, at = {}, 1
    for part, n in counts:
        starts[part], at = (at, n), at + n
    return rows, starts


def page(df: DataFrame, order: list, number: int, size: int, facets: dict[str, Column] | None = None, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Page `number` (from 1) with place, and one row: total, and how many rows each facet has. Only the ranges that the page reaches into are sorted."""
    rows, starts = numbered(df, order, parts)
    first, last = (number - 1) * size + 1, number * size
    reached = {p: s for p, (s, n) in starts.items() if s <= last and s + n > first}
    w = Window.partitionBy("__part").orderBy(*order)
    at = F.create_map(*(F.lit(x) for pair in reached.items() for x in pair)) if reached else F.create_map(F.lit(-1), F.lit(0))
    some = rows.where(F.col("__part").isin(list(reached))) if reached else rows.limit(0)
    out = some.withColumn("place", F.row_number().over(w) - 1 + at[F.col("__part")]).where(F.col("place").between(first, last)).drop("__part")
    about = rows.agg(F.count("*").alias("total"), *(F.count_if(c).alias(n) for n, c in (facets or {}).items()))
    return out, about
