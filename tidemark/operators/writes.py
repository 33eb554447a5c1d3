"""State changes of stored tables, as DataFrames in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import micros
from tidemark.operators import intervals


def anchors_merged(stored: DataFrame, staged: DataFrame) -> DataFrame:
    """sensor, boot, anchor, anchor_at, polls, lo, hi: the first anchor of a boot stays, counts add up, offsets widen. Rows: sensor, boot, at, anchor, polls, lo, hi."""
    both = stored.unionByName(staged).groupBy("sensor", "boot")
    known = F.when(F.col("anchor").isNotNull(), F.struct("at", "anchor"))
    out = both.agg(F.min(known).alias("x"), F.sum("polls").alias("polls"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return out.select("sensor", "boot", F.col("x.anchor").alias("anchor"), F.col("x.at").alias("anchor_at"), "polls", "lo", "hi")


def audit_rows(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, action, old, new (JSON) for each row that was added, removed or changed."""
    old = before.select(key, F.struct(*fields).alias("__o"))
    new = after.select(key, F.struct(*fields).alias("__n"))
    both = old.join(new, key, "full").where(~F.col("__o").eqNullSafe(F.col("__n")))
    action = F.when(F.col("__o").isNull(), "insert").when(F.col("__n").isNull(), "delete").otherwise("update")
    return both.select(key, action.alias("action"), F.to_json("__o").alias("old"), F.to_json("__n").alias("new"))


def twins_merged(events: DataFrame, keys: list[str]) -> DataFrame:
    """kept_id, merged_id, status, note: events without a subject merged into their only twin of equal keys that has one.

    An operator's label wins over open, of two labels the later; notes are joined. events: id, subject, status, status_at, note.
    """
    own = events.where(F.col("subject").isNotNull())
    alone = own.groupBy(*keys).agg(F.count("*").alias("__n"), *(F.any_value(c).alias(f"k_{c}") for c in ("id", "status", "status_at", "note"))).where("__n = 1").drop("__n")
    u = events.where(F.col("subject").isNull()).join(alone, keys)
    later = (F.col("status") != "open") & (F.col("status_at") > F.coalesce("k_status_at", F.lit("1900-01-01").cast("timestamp_ntz")))
    status = F.when((F.col("k_status") == "open") | later, F.col("status")).otherwise(F.col("k_status"))
    note = F.when(F.col("note").isNull() | (F.col("note") == F.col("k_note")), F.col("k_note")).when(F.col("k_note").isNull(), F.col("note")).otherwise(F.concat_ws("\n", "k_note", "note"))
    return u.select(F.col("k_id").alias("kept_id"), F.col("id").alias("merged_id"), status.alias("status"), note.alias("note"))


def tables_with(key: str, **tables: DataFrame) -> DataFrame:
    """key, holds: the names of the tables that hold rows of each key, in order; what has to be gone before a key may go."""
    each = [df.select(key, F.lit(name).alias("name")).distinct() for name, df in tables.items()]
    every = each[0]
    for e in each[1:]:
        every = every.union(e)
    return every.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("holds"))


def first_seen_repaired(rows: DataFrame, windows: DataFrame, first_row: DataFrame) -> DataFrame:
    """rows (id, sensor, first_seen) with a first_seen inside a stale window (sensor, lo, hi, delta_s) moved to the earlier of its first row and itself shifted by the clock's error."""
    inside = intervals.points_inside(rows, windows, ["sensor"], "first_seen", "lo", "hi").groupBy("id").agg(F.min("delta_s").alias("delta_s"))
    out = rows.join(inside, "id", "left").join(first_row.select("id", "first_row"), "id", "left")
    shifted = F.timestamp_micros((micros("first_seen") + F.col("delta_s") * 1_000_000).cast("long")).cast("timestamp_ntz")
    return out.select("id", "sensor", F.when(F.col("delta_s").isNotNull(), F.least("first_row", shifted)).otherwise(F.col("first_seen")).alias("first_seen"))


def stale_twins(history: DataFrame, key: str, config: str, error_s: int, within_s: int) -> DataFrame:
    """key, id of history rows that have a twin with the same configuration at their time plus the clock's error, give or take within_s."""
    tick = F.expr("interval 1 microsecond")
    lo = F.col("ts") + F.make_dt_interval(secs=F.lit(error_s - within_s))
    span = history.select(key, config, F.col("id"), lo.alias("lo"), (F.col("ts") + F.make_dt_interval(secs=F.lit(error_s + within_s)) + tick).alias("hi"))
    twin = history.select(key, config, F.col("ts").alias("at"), F.col("id").alias("other"))
    return intervals.points_inside(twin, span, [key, config], "at", "lo", "hi").where("id <> other").select(key, "id").distinct()


def attached(extracted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """extracted rows with the id of the stored row of equal keys, and `fits`: whether exactly one there is."""
    n = stored.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("id").alias("stored_id"))
    out = extracted.join(n, keys, "left")
    fits = F.coalesce(F.col("__n") == 1, F.lit(False))
    return out.withColumn("fits", fits).withColumn("stored_id", F.when(fits, F.col("stored_id"))).drop("__n")


def pruned(rows: DataFrame, cutoff, synced: str, ts: str, order: str) -> DataFrame:
    """The rows that stay: synchronised ones from the cutoff on; others if a synchronised row of their sensor that came before them in `order` stays (or none went)."""
    w = Window.partitionBy("sensor").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last_known = F.last(F.when(F.col(synced), F.col(ts)), ignorenulls=True).over(w)
    true_time = F.when(F.col(synced), F.col(ts)).otherwise(last_known)
    return rows.withColumn("__t", true_time).where(F.col("__t").isNull() | (F.col("__t") >= cutoff)).drop("__t")


def merge_summary(stored: DataFrame, staged: DataFrame, excluded: DataFrame, keys: list[str], ts: str, table: str) -> DataFrame:
    """table, staged, excluded, inserted, conflicts, min_ts: what an insert-or-ignore merge of one table does, rows of excluded spans (sensor, lo, hi) left out first."""
    kept = intervals.points_outside(staged, excluded, ["sensor"], ts, "lo", "hi")
    one = kept.groupBy(*keys).agg(F.min(ts).alias("__ts"))
    new = one.join(stored.select(*keys).distinct(), keys, "left_anti").agg(F.count("*").alias("inserted"), F.min("__ts").alias("min_ts"))
    n = staged.agg(F.count("*").alias("staged")).join(F.broadcast(kept.agg(F.count("*").alias("__kept")))).join(F.broadcast(new))
    return n.select(F.lit(table).alias("table"), "staged", (F.col("staged") - F.col("__kept")).alias("excluded"), "inserted", (F.col("__kept") - F.col("inserted")).alias("conflicts"), "min_ts")
