"""Alarms and held polls as state with timers, against the whole history, with restarts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import alarms, hold_back

SCHEMA = "sensor string, id long, at timestamp, capturing boolean, discarding boolean, free_gb double"


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get(alarms.ROCKSDB[0])
    spark.conf.set(*alarms.ROCKSDB)
    yield
    spark.conf.set(alarms.ROCKSDB[0], before)


def run(stream, path):
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def test_alarms_equal_the_history_after_restarts(spark, rocksdb, tmp_path):
    rng, rows = random.Random(4), []
    for sensor in "ab":
        at = datetime(2024, 1, 1)
        for k in range(200):
            at += timedelta(seconds=rng.choice([60, 300, 300, 1_500]))
            rows.append((sensor, k, at, rng.random() < 0.4, rng.random() < 0.1, rng.choice([5.0, 50.0, 50.0, None])))
    rows.sort(key=lambda r: r[2])
    for part in range(4):  # each part a file, each file a start of the stream
        spark.createDataFrame(rows[part * 100 : (part + 1) * 100], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(alarms.alarm_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), 900, 10.0), str(tmp_path))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    history = alarms.alarm_history(spark.createDataFrame(rows, SCHEMA), 900, 10.0, F.lit(rows[0][2]))
    want = {tuple(r) for r in history.select("sensor", "alarm", "at", "change", "lasted_s").collect()}
    silent = {r for r in got - want if r[1:2] == ("contact",) or r[3] == "resolve"}  # a sensor's last silence, which the other's later rows let time out
    assert want <= got
    assert got - want == silent
    assert len(got) > 100


def test_polls_wait_for_their_anchor(spark, rocksdb, tmp_path):
    schema = "boot string, mono double, epoch double, arrived timestamp"
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    parts = [
        [("x", 1.0, None, at(0)), ("y", 5.0, None, at(0))],
        [("x", 2.0, None, at(10)), ("y", 6.0, None, at(10))],
        [("x", 3.0, 100.0, at(20)), ("x", 4.0, None, at(20))],
        [("z", 1.0, None, at(200))],
        [("y", 7.0, 50.0, at(210)), ("y", 8.0, None, at(210))],
    ]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(hold_back.held_back(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 3_600), str(tmp_path))
    got = sorted((r.boot, r.mono, r.at, r.verified) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("x", 1.0, 101.0, True), ("x", 2.0, 102.0, True), ("x", 4.0, 104.0, True), ("y", 5.0, None, False), ("y", 6.0, None, False), ("y", 8.0, 58.0, True)]
