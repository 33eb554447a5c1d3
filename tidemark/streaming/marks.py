"""Cursors and dirty marks that advance with the rows they speak of, because both are one commit of a versioned store.

A cursor says up to which number of a source's rows everything is stored. A stream that starts again, even without its
checkpoint, goes on behind it. A dirty mark says from when on a source's rollups are out of date; a refresh rebuilds them
from one version and clears the mark only if no later commit has set it again meanwhile.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ingest import dirtier, touched
from tidemark.sources.store import Change, Snapshot, Store


def cursors(snap: Snapshot) -> dict[str, int]:
    """The last stored number of each source."""
    return {k.removeprefix("cursor/"): v for k, v in snap.marks.items() if k.startswith("cursor/")}


def beyond(rows: DataFrame, snap: Snapshot, source: str, seq: str) -> DataFrame:
    """The rows that no commit has yet: their number is above their source's cursor."""
    known = cursors(snap)
    if not known:
        return rows
    at = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))  # one entry a source
    return rows.where(F.col(seq) > F.coalesce(at[F.col(source).cast("string")], F.lit(-1)))


def append_batch(store: Store, table: str, source: str, seq: str, ts: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: new rows join the days they belong to; cursors, and dirty marks of the earliest new times, are part of the commit.

    Batches have to come in the order of a source's numbers, since what a cursor has passed is taken as stored: rows whose
    numbers are in no order among them belong into one batch.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        base = store.snapshot()
        new = store.scratch(beyond(batch, base, source, seq).withColumn("day", F.to_date(ts)))
        per = new.groupBy(F.col(source).cast("string").alias("source")).agg(F.max(seq).alias("seq"), F.min(ts).cast("string").alias("since")).collect()  # a row a source
        if per:
            stored = base.part(table, touched(new, "day"), new)
            change = Change(stored.select(*new.columns).unionByName(new), "day", (source, ts))

            def marks(m: dict) -> dict:
                for r in per:
                    m[f"cursor/{r['source']}"] = r["seq"]
                    m[f"dirty/{r['source']}"] = dirtier(m.get(f"dirty/{r['source']}"), r["since"], f"{r['source']}#{r['seq']}")
                return m

            store.commit({table: change}, base, marks)
        store.clear_scratch()

    return run


def refresh_from(snap: Snapshot, table: str, source: str, ts: str) -> DataFrame:
    """source, refresh_from of the dirty sources: the hour of the last row before the earliest new one, since a gap may reach over from there."""
    taken = [(k.removeprefix("dirty/"), m["since"]) for k, m in sorted(snap.marks.items()) if k.startswith("dirty/")]
    marks = snap.store.spark.createDataFrame(taken, "__s string, since string").select("__s", F.col("since").cast("timestamp_ntz").alias("since"))
    rows = snap.read(table).select(F.col(source), F.col(ts)).withColumn("__s", F.col(source).cast("string"))
    before = rows.join(F.broadcast(marks), "__s").where(F.col(ts) < F.col("since")).groupBy("__s").agg(F.max(ts).alias("b"))
    start = F.date_trunc("hour", F.coalesce("b", "since")).cast("timestamp_ntz")
    return marks.join(before, "__s", "left").select(F.col("__s").alias("source"), start.alias("refresh_from"))


def refresh(store: Store, table: str, rollup: str, source: str, ts: str, build: Callable[[DataFrame], DataFrame], during: Callable[[], None] | None = None) -> list[str]:
    """Rebuilds the rollup's days of dirty sources from one version and clears their marks, but not marks set since; the sources that stay dirty.

    build: rows to the rollup's rows, with day. during: called before the commit (tests let others commit then).
    """
    snap = store.snapshot()
    taken = {k: m for k, m in snap.marks.items() if k.startswith("dirty/")}
    if taken:
        since = refresh_from(snap, table, source, ts).agg(F.to_date(F.min("refresh_from")).alias("d")).first()["d"]
        days = {d for d in snap.tables[table]["parts"] if d >= str(since)} | {str(since - timedelta(days=1))}
        built = build(snap.part(table, days)).where(F.col("day") >= F.lit(str(since)).cast("date"))
        change = Change(built, "day", (source,), frozenset(d for d in snap.tables.get(rollup, {"parts": {}})["parts"] if d >= str(since)))
        if during:
            during()
        store.commit({rollup: change}, snap, lambda m: {k: v for k, v in m.items() if k not in taken or v != taken[k]})
    return [k.removeprefix("dirty/") for k in store.snapshot().marks if k.startswith("dirty/")]
