"""Streams: ordered micro-batches merged idempotently, rows held back until their clock is known, rollups kept current."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators import merge


def read_batches(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """The landing folder as a stream of files in order of arrival."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def merge_into(target: str, keys: list[str], ts: str, order: list[str], combine: Callable[[DataFrame, DataFrame], DataFrame] | None = None):
    """A foreachBatch function that merges each micro-batch into a table at `target` that is partitioned by the day of `ts`.

    Only the days that a batch touches are read and rewritten. Of a batch's rows of one key the first in `order` counts, and
    stored rows stay as they are, so a batch that runs again changes nothing. `combine` (stored, staged) has to be as
    repeatable. Late rows are merged as any other.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        staged = merge.first_each(batch, keys, order).withColumn("day", F.to_date(ts))
        days = F.broadcast(staged.select("day").distinct())  # as many rows as a batch has days
        stored = spark.read.schema(staged.schema).parquet(target).join(days, "day", "left_semi").select(*staged.columns) if exists(spark, target) else staged.limit(0)
        merged = (combine or (lambda a, b: merge.insert_ignore(a, b, keys, order)))(stored, staged)
        replace_partitions(merged, target, ["day"])

    return run


def replace_partitions(df: DataFrame, target: str, by: list[str]) -> None:
    """Writes df over the partitions that it has rows of; the others stay. The old files go when all of the new ones are there."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(target)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether something is at path, in any file system that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The merged table."""
    return spark.read.parquet(target)


def run_all(stream: DataFrame, each: Callable, checkpoint: str) -> None:
    """Everything that has arrived, then stop."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def hourly_counts(stream: DataFrame, entity: str, ts: str, late: str = "2 hours") -> DataFrame:
    """entity, hour, n as data arrive; rows later than the watermark are not counted here, but are by the batch rollup."""
    return stream.withWatermark(ts, late).groupBy(entity, F.window(ts, "1 hour").alias("w")).agg(F.count("*").alias("n")).select(entity, F.col("w.start").alias("hour"), "n")


def placed_by_anchor(stream: DataFrame, arrived: str = "arrived", timeout_ms: int = 3_600_000) -> DataFrame:
    """Polls of a boot with the true time, epoch + mono, once the boot's anchor has come; until then they are held.

    stream: boot string, mono double, epoch double (an anchor; null in polls), and the time of arrival. When arrivals have gone
    on for the timeout without an anchor, the held polls are let go as unverified. The timeout is one of event time, so a
    stream that has read everything is at rest.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        epoch, held = state.get if state.exists else (None, [])
        held = list(held or [])
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"boot": key[0], "mono": held, "at": pd.Series([None] * len(held), dtype="float64"), "verified": False})
            return
        last = state.getCurrentWatermarkMs()
        for f in frames:
            last = max(last, int(f["arrived"].max().timestamp() * 1000))
            anchors = f["epoch"].dropna()
            if len(anchors):
                epoch = float(anchors.iloc[0]) if epoch is None else epoch
            held += f.loc[f["epoch"].isna(), "mono"].tolist()
        if epoch is not None and held:
            yield pd.DataFrame({"boot": key[0], "mono": held, "at": [epoch + m for m in held], "verified": True})
            held = []
        state.update((epoch, held))
        state.setTimeoutTimestamp(last + timeout_ms)

    marked = stream.withColumnRenamed(arrived, "arrived").withWatermark("arrived", "0 seconds").select("boot", "mono", "epoch", "arrived")
    return marked.groupBy("boot").applyInPandasWithState(run, "boot string, mono double, at double, verified boolean", "epoch double, held array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def stalls(stream: DataFrame, persist_s: int = 600) -> DataFrame:
    """opened and closed stalls by sensor: a reject counter that has been rising for persist_s opens one, the first contact without a reject closes it.

    stream: sensor string, at timestamp, rejects long (a running counter; a smaller one is a restart). State is one row a sensor.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, since, is_open = state.get if state.exists else (None, None, False)
        out = []
        for f in frames:
            for at, n in f.sort_values(["at", "rejects"])[["at", "rejects"]].itertuples(index=False):
                now = at.timestamp()
                rising = before is not None and n > before
                if rising:
                    since = now if since is None else since
                    if not is_open and now - since >= persist_s:
                        is_open = True
                        out.append((key[0], at, "open"))
                else:
                    if is_open:
                        out.append((key[0], at, "close"))
                    since, is_open = None, False
                before = n
        state.update((before, since, is_open))
        yield pd.DataFrame(out, columns=["sensor", "at", "change"]).astype({"at": "datetime64[us]"})

    return stream.groupBy("sensor").applyInPandasWithState(run, "sensor string, at timestamp, change string", "before long, since double, is_open boolean", "append", GroupStateTimeout.NoTimeout)


def growing_sessions(stream: DataFrame, subject: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """subject, first_at, last_at, n of sessions as they grow, in update mode. A session's identity is its subject and first row, which stays while it grows."""
    w = F.session_window(ts, gap)
    grown = stream.withWatermark(ts, gap).groupBy(subject, w.alias("w")).agg(F.count("*").alias("n"), F.min(ts).alias("first_at"), F.max(ts).alias("last_at"))
    return grown.select(subject, "first_at", "last_at", "n")
