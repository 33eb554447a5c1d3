"""A sensor's batch merged into all stored tables in order, as one commit: replayed, interrupted or late, it counts once.

The steps: rows of excluded time are left out (0); devices, newest row wins (1); polls (2); configuration history (3);
observations (4); hourly loads, the fuller row wins (5), and load samples folded into them (6); frequency counts, the
newer wins (7); client tables, whose spans widen and which only a snapshot may write (8); alerts by hash (9); and from
which time on the refresher has work (10), which is a mark in the same commit. Stored rows are read for the touched days
and buckets alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import micros
from tidemark.operators import intervals
from tidemark.sources.store import Change, Snapshot, Store, Written

#: Buckets of the tables that have no day.
BUCKETS = 16


@dataclass(frozen=True)
class Table:
    """How a table merges. at: its time, by which excluded rows are told; day: whether it is laid out by that time's day, which
    its keys then have to tell.

    order: of the rows of a key, stored and staged, the first counts; without it the spans first and last widen.
    takes: all rows, those of access points (aps), those of access points or, in a snapshot, of any known device
    (devices), or none but a snapshot's (none).
    """

    name: str
    keys: tuple[str, ...]
    at: str
    day: bool
    order: tuple[Column, ...] = ()
    spans: tuple[str, str] | None = None
    takes: str = "all"
    dates: bool = False


def _tables() -> tuple[Table, ...]:
    stored_first = F.col("__staged")
    return (
        Table("devices", ("sensor", "device"), "last_seen", False),
        Table("polls", ("sensor", "ts"), "ts", True, (stored_first, F.col("id")), dates=True),
        Table("device_history", ("sensor", "device", "ts"), "ts", True, (stored_first,), takes="devices"),
        Table("observations", ("sensor", "device", "ts"), "ts", True, (stored_first, F.col("id")), takes="aps", dates=True),
        Table("load_hourly", ("sensor", "device", "hour", "channel"), "hour", True, (-F.coalesce("polls", F.lit(-1)), stored_first), takes="aps"),
        Table("freq_hist", ("sensor", "device", "freq"), "updated", False, (-micros("updated"), stored_first), takes="devices"),
        Table("associations", ("sensor", "device", "client"), "last_seen", False, spans=("first_seen", "last_seen"), takes="none"),
        Table("client_bssids", ("sensor", "client", "bssid"), "last_seen", False, spans=("first_seen", "last_seen"), takes="none"),
        Table("probes", ("sensor", "client", "ssid"), "last_seen", False, spans=("first_seen", "last_seen"), takes="none"),
        Table("alerts", ("sensor", "hash"), "ts", False, (stored_first, F.col("ts")), dates=True),
    )


#: Steps in order; load samples are folded into the hourly loads.
STEPS = ("devices", "polls", "device_history", "observations", "load_hourly", "load_samples", "freq_hist", "associations", "client_bssids", "probes", "alerts")
IDENTITY = ("mac", "type", "ssid", "crypt", "channel")


def _placed(rows: DataFrame, t: Table) -> DataFrame:
    """rows with the partition they belong to."""
    return rows.withColumn("day", F.to_date(t.at)) if t.day else rows.withColumn("bucket", F.pmod(F.hash(*t.keys[:2]), F.lit(BUCKETS)))


def touched(rows: DataFrame, by: str) -> set[str]:
    """The partitions that a batch has rows of, as text: as many as its days, or the buckets."""
    return {r[0] for r in rows.select(F.col(by).cast("string")).distinct().collect() if r[0] is not None}


def outside(staged: DataFrame, windows: DataFrame, at: str) -> DataFrame:
    """Rows outside of the excluded windows (sensor, lo, hi; a null end is open); an hour goes if any of it is excluded."""
    lo = F.col("lo") - F.expr("interval 1 hour") + F.expr("interval 1 microsecond") if at == "hour" else F.col("lo")
    return intervals.points_outside(staged, windows.select("sensor", lo.alias("lo"), "hi"), ["sensor"], at, "lo", "hi")


def merged(stored: DataFrame, staged: DataFrame, t: Table) -> DataFrame:
    """One row a key. batch: the batch that a row comes from, or that has widened it."""
    both = stored.withColumn("__staged", F.lit(0)).unionByName(staged.withColumn("__staged", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*t.keys, "__staged")]
    if t.spans:
        first, last = t.spans
        other = [F.any_value(c).alias(c) for c in rest if c not in (first, last, "batch")]
        return both.groupBy(*t.keys).agg(F.min(first).alias(first), F.max(last).alias(last), F.max("batch").alias("batch"), *other)
    best = both.groupBy(*t.keys).agg(F.min_by(F.struct(*rest), F.struct(*t.order)).alias("__x"))
    return best.select(*t.keys, "__x.*")


def devices_merged(stored: DataFrame, staged: DataFrame) -> DataFrame:
    """Identity of the newer row (the staged one if they are as old), first and last seen widened, the maker and the last change kept where the newer row does not know them, current counts by their own time."""
    newest = staged.groupBy("sensor", "device", "bucket").agg(F.max_by(F.struct(*(c for c in staged.columns if c not in ("sensor", "device", "bucket"))), "last_seen").alias("n"))
    keys = ["sensor", "device", "bucket"]
    both = stored.select(*keys, F.struct(*(c for c in stored.columns if c not in keys)).alias("o")).join(newest, keys, "full")
    newer = F.col("n").isNotNull() & (F.col("o").isNull() | (F.col("n.last_seen") >= F.col("o.last_seen")))
    current = F.col("n.cur_at").isNotNull() & (F.col("o.cur_at").isNull() | (F.col("n.cur_at") >= F.col("o.cur_at")))
    out = {c: F.when(newer, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in IDENTITY}
    out["manuf"] = F.coalesce(F.when(newer, F.col("n.manuf")), F.col("o.manuf"), F.col("n.manuf"))
    out["changed_at"] = F.when(newer, F.coalesce("n.changed_at", "o.changed_at")).otherwise(F.col("o.changed_at"))
    out |= {c: F.when(current, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in ("cur_clients", "cur_at")}
    out |= {"first_seen": F.least("o.first_seen", "n.first_seen"), "last_seen": F.greatest("o.last_seen", "n.last_seen")}
    out |= {"ever_ap": F.coalesce("o.ever_ap", F.lit(False)) | F.coalesce("n.ever_ap", F.lit(False)), "batch": F.coalesce("n.batch", "o.batch")}
    return both.select(*keys, *(v.alias(c) for c, v in out.items()))


def hourly_of(samples: DataFrame) -> DataFrame:
    """Load samples (sensor, device, channel, ts, clients) as rows of the hourly loads."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    sums = samples.groupBy("sensor", "device", hour, "channel").agg(F.count("*").alias("polls"), F.sum("clients").alias("clients_sum"), F.max("clients").alias("clients_max"))
    return sums.withColumn("source", F.lit("samples"))


def merge_batch(store: Store, source: str, seq: int, via: str, staged: dict[str, DataFrame], windows: DataFrame | None = None, after: Callable[[str], None] | None = None) -> DataFrame:
    """Merges a source's batch number seq (they come in order) as one commit. step, staged, excluded, inserted, conflicts, min_ts for each step that has rows.

    via: `snapshot` or `ingest`. A batch that was applied before gives no rows and changes nothing. after: called with each
    step's name when its files are written (tests let it fail).
    """
    if via not in ("snapshot", "ingest"):
        raise ValueError(f"via is snapshot or ingest, not {via}")
    base, spark = store.snapshot(), store.spark
    summary: list[tuple] = []
    if int(base.marks.get(f"batch/{source}", 0)) < seq:
        windows = None if windows is None else store.scratch(windows)
        changes, earliest = _steps(store, base, seq, via, staged, windows, summary, after or (lambda _: None))

        def marks(m: dict) -> dict:
            m[f"batch/{source}"] = seq
            if any(r[3] for r in summary):
                m[f"dirty/{source}"] = dirtier(m.get(f"dirty/{source}"), earliest, f"{source}#{seq}")
            return m

        store.publish(changes, base, marks)
        store.clear_scratch()
    return spark.createDataFrame(summary, "step string, staged long, excluded long, inserted long, conflicts long, min_ts timestamp_ntz")


def dirtier(mark: dict | None, since: str | None, by: str) -> dict:
    """A dirty mark moved back to `since` (text of a time; null: now is enough); `by` tells the marks of different batches apart."""
    times = [x for x in ((mark or {}).get("since"), since) if x]
    return {"since": min(times) if times else None, "by": by}


def _steps(store: Store, base: Snapshot, seq: int, via: str, staged: dict[str, DataFrame], windows: DataFrame | None, summary: list, after: Callable) -> tuple[dict[str, Written], str | None]:
    tables = {t.name: t for t in _tables()}
    changes: dict[str, Written] = {}
    earliest: str | None = None

    def devices(condition: str) -> DataFrame:
        """Keys of the stored devices, this batch's included; one that is an access point never stops being one."""
        have = [base.read("devices")] if "devices" in base.tables else []
        have += [store.written("devices", changes["devices"])] if "devices" in changes else []
        known = [d.where(condition).select("sensor", "device") for d in have] or [store.spark.createDataFrame([], "sensor long, device long")]
        return reduce(DataFrame.union, known).distinct()

    def prepared(step: str, t: Table) -> tuple[DataFrame, int, int]:
        """The step's rows where they belong, how many were staged, and how many fell into excluded time."""
        at = "ts" if step == "load_samples" else t.at
        every = store.scratch(staged[step])
        n = every.count()
        rows = every if windows is None else store.scratch(outside(every, windows, at))
        excluded = 0 if windows is None else n - rows.count()
        if t.name == "load_hourly":
            rows = hourly_of(rows) if step == "load_samples" else rows.withColumn("source", F.lit("buffer"))
        if t.takes in ("aps", "devices"):
            rows = rows.join(devices("true" if t.takes == "devices" and via == "snapshot" else "ever_ap"), ["sensor", "device"], "left_semi")
        return store.scratch(_placed(rows, t).withColumn("batch", F.lit(seq))), n, excluded

    def write(step: str, t: Table, rows: DataFrame, n: int, excluded: int) -> None:
        nonlocal earliest
        changes[t.name] = store.write(t.name, Change(rows, "day" if t.day else "bucket", t.keys))
        new = store.written(t.name, changes[t.name]).where(F.col("batch") == seq)
        if t.name == "load_hourly":
            new = new.where(F.col("source") == ("samples" if step == "load_samples" else "buffer"))
        got = new.agg(F.count("*").alias("n"), F.min(t.at).alias("at")).first()
        summary.append((step, n, excluded, got["n"], n - excluded - got["n"], got["at"]))
        if t.dates and got["n"]:
            earliest = min(filter(None, (earliest, str(got["at"]))))
        after(step)

    for step in STEPS:
        t = tables["load_hourly" if step == "load_samples" else step]
        if step not in staged or (t.takes == "none" and via != "snapshot"):
            continue
        rows, n, excluded = prepared(step, t)
        by = "day" if t.day else "bucket"
        if step == "load_samples" and t.name in changes:
            write(step, t, merged(store.written(t.name, changes[t.name]), rows, t), n, excluded)
            continue
        parts = touched(rows, by)
        if step == "load_hourly" and "load_samples" in staged:
            parts |= touched(staged["load_samples"].select(F.to_date("ts").alias("day")), "day")
        old = base.part(t.name, parts) if t.name in base.tables else rows.limit(0)
        if step == "devices":
            rows = rows if windows is None else _starting_after(rows, windows)
            if via == "ingest":
                known = rows.join(old.where("ever_ap").select("sensor", "device"), ["sensor", "device"], "left_semi").where("not coalesce(ever_ap, false)")
                rows = rows.where("ever_ap").unionByName(known)
            write(step, t, devices_merged(old, rows), n, excluded)
        else:
            write(step, t, merged(old, rows, t), n, excluded)
    return changes, earliest


def _starting_after(devices: DataFrame, windows: DataFrame) -> DataFrame:
    """Devices first seen inside a closed window, and seen again after it, start at its end."""
    closed = windows.where("hi is not null").select("sensor", "lo", "hi")
    ends = intervals.points_inside(devices.select("sensor", "device", "first_seen"), closed, ["sensor"], "first_seen", "lo", "hi").groupBy("sensor", "device").agg(F.max("hi").alias("__end"))
    return devices.join(ends, ["sensor", "device"], "left").withColumn("first_seen", F.coalesce("__end", "first_seen")).drop("__end")

