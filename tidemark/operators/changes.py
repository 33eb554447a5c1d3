"""Change data: timelines of fields, validity periods, events between periods. Unknown (null) is not a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def timeline(history: DataFrame, keys: list[str], ts: str, tie: str, fields: list[str]) -> DataFrame:
    """keys, field, at, old, new: where a known field's next known value differs."""
    cases = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("x")
    long = history.select(*keys, ts, tie, cases).select(*keys, ts, tie, "x.field", "x.value").where("value is not null")
    w = Window.partitionBy(*keys, "field").orderBy(ts, tie)
    nxt = long.select(*keys, "field", F.lead(ts).over(w).alias("at"), F.col("value").alias("old"), F.lead("value").over(w).alias("new"))
    return nxt.where("new <> old")


def merged_state(history: DataFrame, keys: list[str], ts: str, tie: str, fields: list[str]) -> DataFrame:
    """history with each field as last known, and is_change: some known field turned into another known value."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    known = {f"__{f}": F.last(f, ignorenulls=True).over(before) for f in fields}
    out = history.withColumns(known)
    differs = [(F.col(f) != F.col(f"__{f}")) for f in fields]
    is_change = F.coalesce(differs[0], F.lit(False))
    for d in differs[1:]:
        is_change = is_change | F.coalesce(d, F.lit(False))
    return out.withColumn("is_change", is_change).withColumns({f: F.coalesce(F.col(f), F.col(f"__{f}")) for f in fields}).drop(*known)


def validity(history: DataFrame, keys: list[str], ts: str, tie: str, state: str) -> DataFrame:
    """keys, period (running number), state, valid_from, valid_to (null: still valid), n: periods of one state, half-open."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    new = history.withColumn("__new", (~F.col(state).eqNullSafe(F.lag(state).over(w))).cast("int"))
    run = new.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    p = run.groupBy(*keys, "__run").agg(F.first(state).alias(state), F.min(ts).alias("valid_from"), F.count("*").alias("n"))
    return p.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy(*keys).orderBy("__run"))).withColumnRenamed("__run", "period")


def period_events(periods: DataFrame, keys: list[str], state: str, rank: Column) -> DataFrame:
    """keys, at, old, new, severity: neighbouring periods as events; a fall of rank is high, a rise info, else low."""
    w = Window.partitionBy(*keys).orderBy("period")
    p = periods.withColumn("__rank", rank).withColumns({"__old": F.lag(state).over(w), "__was": F.lag("__rank").over(w), "__first": F.row_number().over(w) == 1})
    severity = F.when(F.col("__rank") < F.col("__was"), "high").when(F.col("__rank") > F.col("__was"), "info").otherwise("low")
    return p.where("not __first").select(*keys, F.col("valid_from").alias("at"), F.col("__old").alias("old"), F.col(state).alias("new"), severity.alias("severity"))
