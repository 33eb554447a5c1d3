"""Polls held back until their boot's clock is known, as a list in the state that is appended to, not rewritten."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Held(StatefulProcessor):
    """One boot. State: the anchor's epoch once there is one, and the monotonic times of polls that wait for it."""

    def __init__(self, timeout_s: int):
        self.timeout = timeout_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.epoch, self.waiting = handle, handle.getValueState("epoch", "epoch double"), handle.getListState("waiting", "mono double")

    def _let_go(self, boot: str, mono: list[float], epoch: float | None) -> pd.DataFrame:
        at = pd.Series([None if epoch is None else epoch + m for m in mono], dtype="float64")
        return pd.DataFrame({"boot": boot, "mono": mono, "at": at, "verified": epoch is not None})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        epoch = self.epoch.get()[0] if self.epoch.exists() else None
        known, last = epoch, 0
        for f in rows:
            last = max(last, int(f["arrived"].max().timestamp() * 1000))
            anchors, polls = f["epoch"].dropna(), f.loc[f["epoch"].isna(), "mono"]
            if epoch is None and len(anchors):
                epoch = float(anchors.iloc[0])
            if epoch is None and len(polls):
                self.waiting.appendList([(m,) for m in polls.tolist()])
            elif len(polls):
                yield self._let_go(key[0], polls.tolist(), epoch)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if epoch is None:
            self.handle.registerTimer(last + self.timeout)
        elif known is None:
            self.epoch.update((epoch,))
            mono = [x[0] for x in self.waiting.get()] if self.waiting.exists() else []
            self.waiting.clear()
            if mono:
                yield self._let_go(key[0], mono, epoch)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mono = [x[0] for x in self.waiting.get()] if self.waiting.exists() else []
        self.waiting.clear()
        if mono:
            yield self._let_go(key[0], mono, None)

    def close(self) -> None:
        pass


def held_back(stream: DataFrame, timeout_s: int = 3_600, late: str = "0 seconds") -> DataFrame:
    """boot, mono, at, verified of polls: at = epoch + mono once the boot's anchor has come; unverified if arrivals have gone on for the timeout without one.

    stream: boot string, mono double, epoch double (an anchor; null in polls), arrived timestamp. Needs the RocksDB state store
    (`alarms.ROCKSDB`).
    """
    rows = stream.select("boot", "mono", "epoch", "arrived").withWatermark("arrived", late).groupBy("boot")
    return rows.transformWithStateInPandas(Held(timeout_s), "boot string, mono double, at double, verified boolean", "Append", "EventTime")
