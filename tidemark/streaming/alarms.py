"""Alarms of sensors that start and resolve, from a stream of their contacts, and the same from the whole history.

A sensor's contact alarm starts when nothing has been heard of it for the limit, which no row says: a timer of event time
does. A capture alarm is on while a sensor is in contact, does not discard, and has captured nothing for the limit; a disk
alarm while its disk has less than the least that it should have free. What is on, and since when, is the state.

The stream is transformWithState with timers, so it needs the RocksDB state store (`ROCKSDB`), and rows that come in order of
time within the watermark. Replays give the same transitions, since state and timers are part of the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.scalars import micros
from tidemark.operators import halo

ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_OUT = "sensor string, alarm string, at timestamp, change string, lasted_s double"


class Alarms(StatefulProcessor):
    """One sensor's alarms. State: the last contact and capture in microseconds, and since when each alarm is on (0: off)."""

    def __init__(self, limit_s: int, least_free: float):
        self.limit, self.least = limit_s * 1_000_000, least_free

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("alarms", "contact_at long, capture_at long, contact long, capture long, disk long")

    def _switch(self, out: list, on: dict, alarm: str, now: bool, at: int) -> None:
        if now and not on[alarm]:
            on[alarm] = at
            out.append((alarm, at, "start", None))
        elif not now and on[alarm]:
            out.append((alarm, at, "resolve", (at - on[alarm]) / 1e6))
            on[alarm] = 0

    def _rows(self, sensor: str, out: list) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame([(sensor, a, pd.Timestamp(at, unit="us"), c, s) for a, at, c, s in out], columns=["sensor", "alarm", "at", "change", "lasted_s"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.state.get() if self.state.exists() else (None, None, 0, 0, 0)
        contact_at, capture_at, on = before[0], before[1], dict(zip(("contact", "capture", "disk"), before[2:], strict=True))
        out: list = []
        every = pd.concat(list(rows)).sort_values(["at", "id"])
        times = every["at"].astype("datetime64[us]").astype("int64")
        for at, capturing, discarding, free in zip(times, every["capturing"], every["discarding"], every["free_gb"], strict=True):
            if contact_at is not None and at - contact_at > self.limit and not on["contact"]:
                self._silent(out, on, contact_at + self.limit)
            contact_at = int(at)
            capture_at = int(at) if capturing else capture_at
            self._switch(out, on, "contact", False, contact_at)
            self._switch(out, on, "capture", not discarding and (capture_at is None or at - capture_at > self.limit), contact_at)
            self._switch(out, on, "disk", free is not None and free < self.least, contact_at)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((contact_at + self.limit) // 1000 + 1)
        self.state.update((contact_at, capture_at, on["contact"], on["capture"], on["disk"]))
        yield from self._rows(key[0], out)

    def _silent(self, out: list, on: dict, at: int) -> None:
        """Nothing heard: the contact alarm starts; whether it captures is not known, so that alarm ends."""
        self._switch(out, on, "capture", False, at)
        self._switch(out, on, "contact", True, at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before = self.state.get()
        on = dict(zip(("contact", "capture", "disk"), before[2:], strict=True))
        out: list = []
        if not on["contact"]:
            self._silent(out, on, before[0] + self.limit)
        self.state.update((before[0], before[1], on["contact"], on["capture"], on["disk"]))
        yield from self._rows(key[0], out)

    def close(self) -> None:
        pass


def alarm_stream(contacts: DataFrame, limit_s: int, least_free: float, late: str = "0 seconds") -> DataFrame:
    """sensor, alarm, at, change (start, resolve), lasted_s as they come. contacts: sensor string, id, at timestamp, capturing, discarding, free_gb."""
    rows = contacts.withWatermark("at", late).groupBy("sensor")
    return rows.transformWithStateInPandas(Alarms(limit_s, least_free), _OUT, "Append", "EventTime")


def alarm_history(contacts: DataFrame, limit_s: int, least_free: float, now: Column, unit: str = "day") -> DataFrame:
    """The same transitions from a sensor's whole history up to now, by blocks of time."""
    limit = F.expr(f"interval {limit_s} seconds")
    rows = contacts.withColumn("__capture", F.when(F.col("capturing"), F.col("at")))
    own = Window.partitionBy("sensor", halo.BLOCK).orderBy("at", "id")
    placed = halo.blocks(rows, "at", unit)
    last = placed.groupBy("sensor", halo.BLOCK).agg(F.max("__capture").alias("__m"))
    before = last.withColumn("__m", F.max("__m").over(Window.partitionBy("sensor").orderBy(halo.BLOCK).rowsBetween(Window.unboundedPreceding, -1)))
    captured = F.greatest(F.max("__capture").over(own.rowsBetween(Window.unboundedPreceding, 0)), F.col("__m"))
    at = placed.join(before, ["sensor", halo.BLOCK]).withColumn("__last", captured).drop(halo.BLOCK, "__m")
    on = {"capture": ~F.col("discarding") & (F.col("__last").isNull() | (F.col("at") > F.col("__last") + limit)), "disk": F.coalesce(F.col("free_gb") < least_free, F.lit(False))}
    flagged = at.select("sensor", "id", "at", *(v.alias(k) for k, v in on.items()))
    near = halo.with_rows_before(flagged, ["sensor"], "at", "id", 1, unit)
    lagged = halo.inside(near.withColumns({f"b_{c}": F.lag(c).over(own) for c in ("at", "capture", "disk")})).drop(halo.BLOCK)
    silent = F.coalesce(F.col("at") > F.col("b_at") + limit, F.lit(False))
    was = lambda c: F.coalesce(f"b_{c}", F.lit(False))
    change = lambda alarm, at, kind, when: F.when(when, F.struct(F.lit(alarm).alias("alarm"), at.alias("at"), F.lit(kind).alias("change")))
    lost = F.col("b_at") + limit
    found = F.array_compact(F.array(
        change("contact", lost, "start", silent), change("contact", F.col("at"), "resolve", silent), change("capture", lost, "resolve", silent & was("capture")), change("capture", F.col("at"), "start", F.col("capture") & (silent | ~was("capture"))),
        change("capture", F.col("at"), "resolve", ~silent & was("capture") & ~F.col("capture")), change("disk", F.col("at"), "start", F.col("disk") & ~was("disk")), change("disk", F.col("at"), "resolve", ~F.col("disk") & was("disk")),
    ))
    past = lagged.select("sensor", F.inline(found))
    newest = flagged.groupBy("sensor").agg(F.max_by("capture", F.struct("at", "id")).alias("capture"), F.max("at").alias("at")).where(F.col("at") + limit < now)
    ends = newest.select("sensor", F.inline(F.array_compact(F.array(change("contact", F.col("at") + limit, "start", F.lit(True)), change("capture", F.col("at") + limit, "resolve", F.col("capture"))))))
    every = past.union(ends)
    w = Window.partitionBy("sensor", "alarm").orderBy("at", F.desc("change"))  # a start and its end of the same instant do not occur; one row a transition
    lasted = F.when(F.col("change") == "resolve", (micros("at") - F.lag(micros("at")).over(w)) / 1e6)
    return every.withColumn("lasted_s", lasted)
