"""Versioned tables, the ingest that dies between two tables, cursors and marks."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ingest
from tidemark.session import shared_folder
from tidemark.sources.store import Change, Conflict, Store
from tidemark.streaming import marks


@pytest.fixture
def store(spark):
    return Store(spark, shared_folder(spark, "test"))


def rows(spark, *days):
    return spark.createDataFrame([(k, d) for k, d in enumerate(days)], "id long, day string").withColumn("day", F.to_date("day"))


def test_versions_and_pruning(spark, store):
    v1 = store.commit({"a": Change(rows(spark, "2024-01-01", "2024-01-02", "2024-01-02", None), "day", ("id",)), "b": Change(rows(spark, "2024-01-01"), "day", ("id",))})
    v2 = store.commit({"a": Change(rows(spark, "2024-01-02"), "day", ("id",), frozenset({"2024-01-01"}))})
    assert [v1.read("a").count(), v1.read("b").count(), v2.read("a").count(), v2.read("b").count()] == [4, 1, 2, 1]
    assert v2.tables["b"] == v1.tables["b"]
    day = v2.read("a").where("day = date '2024-01-02'")
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert day.select(F.input_file_name()).distinct().count() == 1
    assert store.snapshot(1).read("a").count() == 4
    assert store.vacuum(keep=1) == 0  # the row without a day still needs the first folder
    assert (store.versions(), store.snapshot().read("a").count()) == ([2], 2)


def test_conflicts_and_rebasing(spark, store):
    base = store.commit({"a": Change(rows(spark, "2024-01-01", "2024-01-02"), "day", ("id",))})
    store.commit({"a": Change(rows(spark, "2024-01-01"), "day", ("id",))}, base)
    after = store.commit({"a": Change(rows(spark, "2024-01-02", "2024-01-02"), "day", ("id",))}, base)  # another day: on top of the newest
    assert (after.version, after.read("a").count()) == (3, 3)
    with pytest.raises(Conflict):
        store.commit({"a": Change(rows(spark, "2024-01-01"), "day", ("id",))}, base)
    assert store._put(3, {"tables": {}, "marks": {}}) is False


def test_export_of_an_old_version(spark, store):
    v1 = store.commit({"a": Change(rows(spark, "2024-01-01", "2024-01-02"), "day", ("id",))})
    store.commit({"a": Change(rows(spark, "2024-01-02"), "day", ("id",), frozenset({"2024-01-01"}))})
    about = store.export(f"{store.root}-copy", v1.version).first()
    assert (about["table"], about["version"], about["n_rows"]) == ("a", 1, 2)
    assert spark.read.parquet(f"{store.root}-copy/a").count() == 2


def batch(spark, shift=0):
    ts = lambda h: f"timestamp_ntz '2024-01-0{1 + (h + shift) // 24} {(h + shift) % 24:02d}:00:00'"
    sql = lambda *r: spark.sql(" union all ".join(f"select {x}" for x in r))
    device = lambda d, h, ap, manuf="null": f"1L as sensor, {d}L as device, 'm{d}' as mac, 't' as type, 's{h}' as ssid, 'c' as crypt, {h} as channel, {manuf} as manuf, {ts(h)} as first_seen, {ts(h + 3)} as last_seen, {ts(h)} as changed_at, {h}L as cur_clients, {ts(h)} as cur_at, {ap} as ever_ap"
    return {
        "devices": sql(device(1, 3, "true", "'maker'"), device(2, 4, "false")),
        "polls": sql(f"1L as sensor, 7L as id, {ts(3)} as ts, true as ok", f"1L, 8L, {ts(5)}, true", f"1L, {9 + shift}L, {ts(20)}, true"),
        "device_history": sql(f"1L as sensor, 1L as device, {ts(3)} as ts, 'x' as crypt", f"1L, 2L, {ts(3)}, 'y'", f"1L, 99L, {ts(3)}, 'unknown'"),
        "observations": sql(f"1L as sensor, 1L as device, {5 + shift}L as id, {ts(4)} as ts, -50L as level", f"1L, 2L, 6L, {ts(4)}, -50L"),
        "load_hourly": sql(f"1L as sensor, 1L as device, {ts(3)} as hour, 6 as channel, 5L as polls, 9L as clients_sum, 3L as clients_max"),
        "load_samples": sql(*(f"1L as sensor, 1L as device, 6 as channel, {ts(3 + k % 2)} + interval {k} minutes as ts, {k}L as clients" for k in range(12))),
        "freq_hist": sql(f"1L as sensor, 1L as device, 2412 as freq, {3 + shift}L as packets, {ts(3)} as updated"),
        "associations": sql(f"1L as sensor, 1L as device, 'k' as client, {ts(3)} as first_seen, {ts(4)} as last_seen"),
        "client_bssids": sql(f"1L as sensor, 'k' as client, 1L as bssid, {ts(3)} as first_seen, {ts(4)} as last_seen"),
        "probes": sql(f"1L as sensor, 'k' as client, 'home' as ssid, {ts(3)} as first_seen, {ts(4)} as last_seen"),
        "alerts": sql(f"1L as sensor, 77L as hash, {ts(3)} as ts", f"1L, {78 + shift}L, {ts(6)}"),
    }


def content(store):
    s = store.snapshot()
    return s.version, s.marks, {t: sorted(map(str, s.read(t).collect())) for t in sorted(s.tables)}


def test_ten_steps(spark, store):
    closed = "select 1L as sensor, timestamp_ntz '2024-01-01 05:00:00' as lo, timestamp_ntz '2024-01-01 05:30:00' as hi"
    windows = spark.sql(f"{closed} union all select 1L, timestamp_ntz '2024-01-09 05:00:00', null")
    got = {r["step"]: tuple(r)[1:5] for r in ingest.merge_batch(store, "1", 1, "snapshot", batch(spark), windows).collect()}
    assert list(got) == list(ingest.STEPS)
    assert got["polls"] == (3, 1, 2, 0)
    assert got["device_history"] == (3, 0, 2, 1)  # a device that nobody knows
    assert got["observations"] == (2, 0, 1, 1)  # only access points
    assert got["load_hourly"] == (1, 0, 1, 0)
    assert got["load_samples"] == (12, 0, 2, 10)  # six polls are more than five
    s = store.snapshot()
    assert s.marks["batch/1"] == 1
    assert s.marks["dirty/1"]["since"] == "2024-01-01 03:00:00"
    assert [(r["polls"], r["source"]) for r in s.read("load_hourly").orderBy("hour").collect()] == [(6, "samples"), (6, "samples")]

    live = {r["step"]: tuple(r)[1:5] for r in ingest.merge_batch(store, "1", 2, "ingest", batch(spark, 24), windows).collect()}
    assert not {"associations", "client_bssids", "probes"} & set(live)
    assert live["devices"] == (2, 0, 1, 1)  # the other is no access point
    assert (live["polls"], live["alerts"]) == ((3, 0, 3, 0), (2, 0, 1, 1))  # an alert is known by its hash, whatever its day
    d = {r["device"]: r for r in store.snapshot().read("devices").collect()}
    assert (d[1]["manuf"], str(d[1]["first_seen"]), str(d[1]["last_seen"]), d[1]["batch"]) == ("maker", "2024-01-01 03:00:00", "2024-01-02 06:00:00", 2)
    before = content(store)
    assert ingest.merge_batch(store, "1", 2, "ingest", batch(spark, 24), windows).count() == 0
    assert content(store) == before
    with pytest.raises(ValueError, match="snapshot or ingest"):
        ingest.merge_batch(store, "1", 3, "mail", {})


def test_a_batch_that_dies_is_done_again_in_full(spark, store):
    whole = Store(spark, shared_folder(spark, "whole"))
    first = {k: v for k, v in batch(spark).items() if k in ("devices", "polls", "load_hourly", "alerts")}
    second = {k: v for k, v in batch(spark, 24).items() if k in first}
    for s in (store, whole):
        ingest.merge_batch(s, "1", 1, "snapshot", first)
    seen = content(store)
    for step in first:

        def die(done, step=step):
            if done == step:
                raise OSError(step)

        with pytest.raises(OSError, match=step):
            ingest.merge_batch(store, "1", 2, "ingest", second, after=die)
        assert content(store) == seen  # nothing of it is to be seen
    for s in (store, whole):
        ingest.merge_batch(s, "1", 2, "ingest", second)
    assert content(store) == content(whole)
    assert store.vacuum() > 0
    assert content(store) == content(whole)


def arrivals(spark, *rows):
    return spark.createDataFrame([(s, n, f"2024-01-0{d} 10:00:00") for s, n, d in rows], "sensor long, seq long, at string").select("sensor", "seq", F.col("at").cast("timestamp_ntz").alias("ts"))


def test_cursors_survive_a_lost_checkpoint(spark, store):
    run = marks.append_batch(store, "rows", "sensor", "seq", "ts")
    run(arrivals(spark, (1, 1, 1), (1, 2, 2), (2, 1, 1)), 0)
    run(arrivals(spark, (1, 1, 1), (1, 2, 2), (2, 1, 1)), 0)  # the same batch again
    run(arrivals(spark, (1, 2, 2), (1, 3, 1), (2, 2, 5)), 0)  # another start: one row known, one late
    snap = store.snapshot()
    assert (snap.version, marks.cursors(snap)) == (2, {"1": 3, "2": 2})
    assert sorted((r["sensor"], r["seq"]) for r in snap.read("rows").collect()) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2)]


def test_a_refresh_clears_no_later_mark(spark, store):
    counts = lambda e: e.groupBy("sensor", "day").agg(F.count("*").alias("n"))
    add = marks.append_batch(store, "rows", "sensor", "seq", "ts")
    add(arrivals(spark, (1, 1, 2), (1, 2, 3), (2, 1, 4)), 0)
    assert marks.refresh(store, "rows", "daily", "sensor", "ts", counts) == []
    add(arrivals(spark, (1, 3, 3)), 1)
    assert [tuple(map(str, r)) for r in marks.refresh_from(store.snapshot(), "rows", "sensor", "ts").collect()] == [("1", "2024-01-02 10:00:00")]
    dirty = marks.refresh(store, "rows", "daily", "sensor", "ts", counts, during=lambda: add(arrivals(spark, (1, 4, 2)), 2))
    assert dirty == ["1"]  # the row that came meanwhile still has to be counted
    assert marks.refresh(store, "rows", "daily", "sensor", "ts", counts) == []
    got = {(r["sensor"], str(r["day"])): r["n"] for r in store.snapshot().read("daily").collect()}
    assert got == {(1, "2024-01-02"): 2, (1, "2024-01-03"): 2, (2, "2024-01-04"): 1}
