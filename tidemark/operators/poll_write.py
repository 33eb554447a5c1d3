"""A collector's polls written with all that belongs to them, as one commit.

Of each poll its devices' readings, its alerts (once a hash), its boot's clock anchor (the first synchronised poll's) and
its load are stored together. Load of polls whose clock was not right yet waits, by boot, and is folded into the hours of
true time (anchor's wall - anchor's mono + mono) with the commit that brings the anchor. Records that cannot be stored
are left out and counted; the poll and its other records stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import micros
from tidemark.operators.ingest import BUCKETS, touched
from tidemark.sources.store import Change, Snapshot, Store


def storable() -> Column:
    """Whether a record can be stored: it names its device, and its level is one byte's."""
    return F.col("device").isNotNull() & (F.col("level").isNull() | F.col("level").between(-128, 127))


def _bucket(*keys: str) -> Column:
    return F.pmod(F.hash(*keys), F.lit(BUCKETS)).alias("bucket")


def _stored(base: Snapshot, table: str, rows: DataFrame, by: str) -> DataFrame:
    return base.part(table, touched(rows, by), rows).select(*rows.columns) if table in base.tables else rows.limit(0)


def _added(base: Snapshot, table: str, rows: DataFrame, by: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The stored rows of the touched partitions, and the staged ones of keys that they do not have."""
    old = _stored(base, table, rows, by)
    return old, rows.join(old.select(*keys), keys, "left_anti")


def write_polls(store: Store, source: str, seq: int, polls: DataFrame, records: DataFrame, alerts: DataFrame) -> bool:
    """Whether the source's group of polls number seq was new and is now stored.

    polls: sensor, id, ts, boot, mono (seconds, null: unknown), synced; records: sensor, poll, ts, device, level, clients;
    alerts: sensor, poll, hash. A poll's id, and a device in a poll, come once.
    """
    base = store.snapshot()
    if int(base.marks.get(f"polls/{source}", 0)) >= seq:
        return False
    p = store.scratch(polls.withColumn("day", F.to_date("ts")))
    old_polls, new_polls = _added(base, "polls", p.withColumns({c: F.lit(0).cast("long") for c in ("new_obs", "new_alerts", "skipped")}), "day", ["sensor", "id"])

    r = store.scratch(records.withColumn("day", F.to_date("ts")).withColumn("fits", storable()))
    old_obs, new_obs = _added(base, "observations", r.where("fits").select("sensor", "poll", "device", "ts", "level", "day"), "day", ["sensor", "poll", "device"])
    first = alerts.groupBy("sensor", "hash").agg(F.min("poll").alias("poll")).withColumn("bucket", _bucket("sensor", "hash"))
    old_alerts, new_alerts = _added(base, "alerts", first, "bucket", ["sensor", "hash"])

    count = lambda rows, name: rows.groupBy("sensor", F.col("poll").alias("id")).agg(F.count("*").alias(name))
    counted = new_polls.drop("new_obs", "new_alerts", "skipped")
    for rows, name in ((new_obs, "new_obs"), (new_alerts, "new_alerts"), (r.where("not fits"), "skipped")):
        counted = counted.join(count(rows, name), ["sensor", "id"], "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))

    known = p.where("synced and boot is not null and mono is not null").groupBy("sensor", "boot")
    wall = F.floor(micros("ts") / 1_000_000)
    anchor = known.agg(F.min_by(F.struct(F.col("id").alias("poll"), "mono", wall.alias("wall")), "id").alias("a")).select("sensor", "boot", "a.*").withColumn("bucket", _bucket("sensor", "boot"))
    old_anchors, new_anchors = _added(base, "anchors", anchor, "bucket", ["sensor", "boot"])

    loads = r.where("fits and clients is not null").join(p.select("sensor", F.col("id").alias("poll"), "boot", "mono", "synced"), ["sensor", "poll"])
    waiting = loads.where("not synced and boot is not null and mono is not null").select("sensor", "boot", "poll", "device", "mono", "clients", _bucket("sensor", "boot"))
    buckets = {str(k) for k in range(BUCKETS)}  # an anchor may free what waits in any
    pending = (base.part("load_pending", buckets, waiting).select(*waiting.columns) if "load_pending" in base.tables else waiting.limit(0)).unionByName(waiting)
    every = (base.read("anchors").select(*anchor.columns).union(new_anchors) if "anchors" in base.tables else new_anchors).select("sensor", "boot", (F.col("wall") - F.col("mono")).alias("epoch"))
    freed = pending.join(every, ["sensor", "boot"], "left")
    true_hour = F.timestamp_seconds(F.floor(F.floor(F.col("epoch") + F.col("mono") + 0.5) / 3600) * 3600).cast("timestamp_ntz")
    direct = loads.where("synced").select("sensor", "device", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "clients")
    placed = direct.union(freed.where("epoch is not null").select("sensor", "device", true_hour.alias("hour"), "clients"))
    hours = placed.groupBy("sensor", "device", "hour").agg(F.count("*").alias("polls"), F.sum("clients").alias("clients")).withColumn("day", F.to_date("hour"))
    hours = store.scratch(hours)
    old_hours = _stored(base, "load_hourly", hours, "day")
    summed = old_hours.unionByName(hours).groupBy("sensor", "device", "hour", "day").agg(F.sum("polls").alias("polls"), F.sum("clients").alias("clients"))

    changes = {
        "polls": Change(old_polls.unionByName(counted.select(*old_polls.columns)), "day", ("sensor", "ts")),
        "observations": Change(old_obs.unionByName(new_obs), "day", ("sensor", "device")),
        "alerts": Change(old_alerts.unionByName(new_alerts.select(*old_alerts.columns)), "bucket", ("sensor", "hash")),
        "anchors": Change(old_anchors.unionByName(new_anchors.select(*old_anchors.columns)), "bucket", ("sensor", "boot")),
        "load_pending": Change(freed.where("epoch is null").select(*waiting.columns), "bucket", ("sensor", "boot"), frozenset(base.tables.get("load_pending", {"parts": {}})["parts"])),
        "load_hourly": Change(summed, "day", ("sensor", "device")),
    }
    store.commit(changes, base, lambda m: m | {f"polls/{source}": seq})
    store.clear_scratch()
    return True
