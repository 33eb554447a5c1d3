"""Streams against their batch results, and the file formats."""

import gzip
import json
from datetime import datetime

from pyspark.sql import functions as F

from tidemark.sources import files
from tidemark.streaming import merge_stream


def test_stream_of_batches_equals_one_merge(spark, tmp_path):
    schema = "id long, at timestamp, v double"
    landing = str(tmp_path / "in")
    for lo, hi in ((0, 50), (30, 80), (0, 50)):  # overlaps, and a replay
        spark.range(lo, hi).selectExpr("id", "timestamp_seconds(id) as at", "cast(id as double) as v").coalesce(1).write.mode("append").parquet(landing)
    stream = merge_stream.read_batches(spark, landing, schema)
    target = str(tmp_path / "out")
    merge_stream.run_all(stream, merge_stream.merge_into(target, ["id"], "at", ["v"]), str(tmp_path / "check"))
    got = merge_stream.latest(spark, target)
    assert (got.count(), got.select("id").distinct().count()) == (80, 80)


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    each = merge_stream.merge_into(str(tmp_path / "out"), ["id"], "at", ["v"])
    day = lambda n: spark.range(5).selectExpr("id", f"timestamp'2024-03-0{n} 10:00:00' as at", "id * 2 as v")
    each(day(1), 0)
    each(day(2).withColumn("id", F.col("id") + 100), 1)
    files = {p for p in (tmp_path / "out").glob("day=2024-03-01/*.parquet")}
    each(day(2).withColumn("id", F.col("id") + 100), 1)
    got = merge_stream.latest(spark, str(tmp_path / "out"))
    assert sorted((r.id, r.v) for r in got.collect()) == sorted([(i, 2 * i) for i in range(5)] + [(i + 100, 2 * i) for i in range(5)])
    assert files == {p for p in (tmp_path / "out").glob("day=2024-03-01/*.parquet")}  # untouched days are not rewritten
    # of one batch's rows of a key the first in order counts, whatever their order of arrival
    twice = spark.createDataFrame([(7, 9), (7, 3), (7, 5)], "id long, v long").selectExpr("id", "timestamp'2024-03-05 10:00:00' as at", "v")
    each(twice, 2)
    each(twice.orderBy("v"), 2)
    assert [r.v for r in merge_stream.latest(spark, str(tmp_path / "out")).where("id = 7").collect()] == [3]


def test_polls_wait_for_their_anchor(spark, tmp_path):
    landing = str(tmp_path / "in")
    schema = "boot string, mono double, epoch double, arrived timestamp"
    rows = [("a", 1.0, None), ("a", 2.0, None), ("b", 1.0, None), ("a", 3.0, 1000.0), ("c", 1.0, None), ("c", 2.0, None)]
    for i, r in enumerate(rows):
        spark.createDataFrame([(*r, datetime(2024, 3, 1, i))], schema).coalesce(1).write.mode("append").parquet(landing)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing)
    q = merge_stream.placed_by_anchor(stream).writeStream.format("memory").queryName("placed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = spark.table("placed").collect()
    assert sorted((r.boot, r.mono, r["at"]) for r in got if r.verified) == [("a", 1.0, 1001.0), ("a", 2.0, 1002.0)]
    assert [(r.boot, r.mono) for r in got if not r.verified] == [("b", 1.0)]  # let go an hour of arrivals later


def test_stalls_open_after_a_while_and_close(spark, tmp_path):
    landing = str(tmp_path / "in")
    rows = [("s", datetime(2024, 3, 1, 0, m), n) for m, n in ((0, 0), (1, 1), (5, 2), (12, 3), (13, 4), (14, 4), (15, 5))]
    for r in rows:
        spark.createDataFrame([r], "sensor string, at timestamp, rejects long").coalesce(1).write.mode("append").parquet(landing)
    stream = spark.readStream.schema("sensor string, at timestamp, rejects long").option("maxFilesPerTrigger", 1).parquet(landing)
    q = merge_stream.stalls(stream).writeStream.format("memory").queryName("stalled").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted((r.at.minute, r.change) for r in spark.table("stalled").collect()) == [(12, "open"), (14, "close")]


def test_sessions_keep_their_identity_while_they_grow(spark, tmp_path):
    landing = str(tmp_path / "in")
    times = [datetime(2024, 3, 1, 0, m) for m in (0, 10, 55)] + [datetime(2024, 3, 1, 0, 20)]
    for at in times:
        spark.createDataFrame([("u", at)], "who string, at timestamp").coalesce(1).write.mode("append").parquet(landing)
    stream = spark.readStream.schema("who string, at timestamp").option("maxFilesPerTrigger", 4).parquet(landing)
    q = merge_stream.growing_sessions(stream, "who", "at").writeStream.format("memory").queryName("sessions").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted((r.first_at.minute, r.last_at.minute, r.n) for r in spark.table("sessions").collect()) == [(0, 20, 3), (55, 55, 1)]


def test_formats(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,start\n# a comment\n1,2024-03-01\n")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "t.csv"), "id int, start string").collect()] == [(1, "2024-03-01")]
    with gzip.open(tmp_path / "b.json.gz", "wt") as f:
        f.write(json.dumps({"v": 1}) + "\nnot json\n")
    got = files.read_json_batches(spark, str(tmp_path / "b.json.gz"), "v int").collect()
    assert sorted((r.v is None, r._corrupt is None) for r in got) == [(False, True), (True, False)]
    (tmp_path / "e.sql").write_text("COPY public.polls (id, t) FROM stdin;\n1\ta\\\\tb\\tc\\\\\\\\d\\ne\n\\.\n")
    assert [r.t for r in files.copy_blocks(spark, str(tmp_path / "e.sql"), "polls", ["id", "t"]).collect()] == ["a\\tb\tc\\\\d\ne"]
    (tmp_path / "d.sql").write_text("x\nCOPY public.polls (id, t) FROM stdin;\n1\ta\n2\t\\N\n\\.\nCOPY public.other (id) FROM stdin;\n9\n\\.\n")
    assert sorted(map(tuple, files.copy_blocks(spark, str(tmp_path / "d.sql"), "polls", ["id", "t"]).collect())) == [("1", "a"), ("2", None)]
    text = "COPY public.polls (t, id) FROM stdin;\na\t1\nCOPY that row please\t2\nCOPY public.other (x) FROM stdin;\t3\n\\.\nCOPY public.other (x) FROM stdin;\n9\n\\.\nCOPY public.polls (t, id) FROM stdin;\nb\t4\n\\.\n"
    (tmp_path / "c.sql").write_text(text)
    assert sorted(r.id for r in files.copy_blocks(spark, str(tmp_path / "c.sql"), "polls", ["t", "id"]).collect()) == ["1", "2", "3", "4"]
    old = spark.createDataFrame([("1",)], "id string")
    assert files.aligned(old, {"id": "int", "extra": "double"}).first().extra is None
    df = spark.createDataFrame([(1, "=1+1", datetime(2024, 3, 1))], "id int, s string, at timestamp")
    files.write_csv(df, str(tmp_path / "o"), ["id"], ("at",))
    assert spark.read.csv(str(tmp_path / "o"), header=True).first()["s"] == "'=1+1"
