"""Queries against their SQL on inputs that the generated tables do not hold."""

import datetime as dt

import compare
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidemark import queries_audit, queries_functions, queries_passes, queries_relational, queries_store, queries_writes  # noqa: F401  register more
from tidemark.operators import intervals, ranks, twin
from tidemark.queries import ORACLE_SQL, QUERIES
from tidemark.session import shared_folder
from tidemark.sources.store import Store
from tidemark.streaming import marks, merge_stream


def same_as_sql(spark, folder, name, **tables):
    """The query's rows, which are those of its SQL over these tables."""
    for t, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{t}.parquet")
    df = QUERIES[name](spark, str(folder))
    got = compare.rows_of(df)
    names, want = compare.sql_rows(folder, ORACLE_SQL[name], tables)
    assert names == sorted(df.columns)
    assert got == want
    return got


def events(n, ts, user_id, event_type="view", value=6.0, k=1):
    each = lambda x: [x(i) if callable(x) else x for i in range(n)]
    props = each(lambda i: f'{{"k": {k(i) if callable(k) else k}}}')
    return {"event_id": list(range(n)), "ts": pa.array(each(ts), pa.timestamp("us")), "user_id": each(user_id), "event_type": each(event_type), "value": each(value), "props": props}


def test_an_arrival_of_many_files_is_stored_whole(spark):
    store = Store(spark, shared_folder(spark, "arrival"))
    rows = spark.range(90).select(F.col("id").alias("seq"), (F.col("id") % 2).alias("sensor"), F.lit("2024-01-01 10:00:00").cast("timestamp_ntz").alias("ts"))
    rows.repartition(9, "seq").withColumn("file", F.lit(0)).write.partitionBy("file").parquet(f"{store.root}-landing")
    merge_stream.run_all(queries_store._landed(store, rows.schema, "0"), marks.append_batch(store, "rows", "sensor", "seq", "ts"), f"{store.root}-run")
    assert store.snapshot().read("rows").count() == 90


def test_an_order_of_seventeen_lines(spark, tmp_path):
    n = 17 + 101
    line = {
        "l_orderkey": [1] * 17 + [2] * 101, "l_partkey": [9] + [1] * (n - 1), "l_linenumber": pa.array([1] * n, pa.int32()), "l_quantity": [5.0] * (n - 1) + [0.0], "l_extendedprice": [float(i) for i in range(n)], "l_returnflag": ["A"] * n,
    }
    same_as_sql(spark, tmp_path, "validate_boots_gaps", lineitem=line)


def test_retention_at_the_last_half_second(spark, tmp_path):
    ts = [dt.datetime(2024, 1, 30, 23, 59, 58, 500000), dt.datetime(2024, 1, 30, 23, 59, 59, 499999), dt.datetime(2024, 1, 30, 23, 59, 59, 500000), dt.datetime(2024, 1, 30, 23, 59, 59, 700000), dt.datetime(2024, 1, 6, 0, 13, 20, 500000), dt.datetime(2024, 1, 6, 0, 13, 20, 600000)]
    same_as_sql(spark, tmp_path, "fn_retention_risk", events=events(6, ts.__getitem__, lambda i: 2 if i > 3 else 1, k=2))


def test_durations_beside_a_half_hundredth(spark, tmp_path):
    key = [i % 1000 for i in range(20_000)]
    price = [(i // 20 + 0.5) / 100 * (1 + k) for i, k in zip(range(20_000), key, strict=True)]
    same_as_sql(spark, tmp_path, "fn_fmt_dur", orders={"o_orderkey": key, "o_totalprice": price})


def test_a_customer_without_orders(spark, tmp_path):
    customer = {"c_custkey": [3, 6, 7, 200, 203, 20]}
    orders = {"o_custkey": [6, 3], "o_orderkey": [1, 5], "o_totalprice": [1.0, 2.0]}
    same_as_sql(spark, tmp_path, "fn_ap_band", customer=customer, orders=orders)


def plan_of(spark, name):
    return QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_dealt_intervals_are_not_broadcast(spark):
    for name in ("filter_not_exists_interval", "join_interval_overlap", "join_point_in_interval"):
        assert "Broadcast" not in plan_of(spark, name)


def test_intervals_of_any_length_are_dealt_twice_at_most(spark):
    rows = [(i, f"2023-12-31 23:{i % 60:02d}:00", 60 * 3 ** (i % 15)) for i in range(60)]
    spans = spark.createDataFrame(rows, "id int, lo string, s int").select("id", F.col("lo").cast("timestamp_ntz").alias("lo"), F.expr("cast(lo as timestamp_ntz) + make_dt_interval(0, 0, 0, s)").alias("hi"))
    assert intervals._dealt(spans, "lo", "hi").groupBy("id").count().agg(F.max("count")).first()[0] == 2


def test_audits_that_share_an_instant_with_readings(spark, tmp_path):
    start = dt.datetime(2024, 1, 2, 9, 59, 59)
    seconds = [0, 0, 1, 7200, 7201, 7199, 7200, 14400, 3600, 1, 7200, 0]  # window ends, doubles and hours' turns
    kinds = ["signup", "view", "view", "signup", "view", "error", "view", "signup", "view", "signup", "view", "signup"]
    e = events(12, lambda i: start + dt.timedelta(seconds=seconds[i]), lambda i: (0, 3, 3, 0, 1, 3, 3, 6, 0, 2, 6, 5)[i], kinds.__getitem__, k=lambda i: 17 * (i % 2))
    assert len(same_as_sql(spark, tmp_path, "ts_audit_windows", events=e)) > 0
    same_as_sql(spark, tmp_path, "ts_audit_summary", events=e)
    assert not any(">= lo" in plan_of(spark, name) for name in ("ts_audit_windows", "ts_audit_summary"))  # no pairs


def test_audits_of_one_id(spark, tmp_path):
    hour = [0, 1, 5, 0.5, 1.5, 5.5, 6, 1, 5.5, 0]  # windows of id 0 that overlap, lie apart and are another sensor's; the last two audits have no id
    e = events(10, lambda i: dt.datetime(2024, 1, 2) + dt.timedelta(hours=hour[i]), lambda i: (0, 3, 0, 6, 6, 6, 9, 1, 3, 0)[i], lambda i: "signup" if i in (0, 1, 2, 7, 8, 9) else "view", k=lambda i: 17 * (i % 2))
    e["event_id"] = pa.array([0, 0, 0, 3, 4, 5, 6, 0, None, None], pa.int64())
    assert len(same_as_sql(spark, tmp_path, "ts_audit_windows", events=e)) == 2
    same_as_sql(spark, tmp_path, "ts_audit_summary", events=e)


def test_points_without_a_member_or_a_key(spark):
    ts = lambda h, m=0: dt.datetime(2024, 1, 2, h, m)
    windows = spark.createDataFrame([(0, 1, ts(10)), (None, 2, ts(10)), (1, 3, ts(10))], "sensor int, audit int, lo timestamp_ntz")
    rows = [(0, None, ts(10, 30), True), (0, None, ts(10, 30), None), (0, 5, ts(11), False), (0, 5, ts(11, 30), True), (0, None, ts(12), True), (None, 7, ts(10, 30), True), (1, None, ts(10), True)]
    points = spark.createDataFrame(rows, "sensor int, ap int, ts timestamp_ntz, floor boolean")
    got = ranks.seen_in_windows(windows, points, ["sensor"], "audit", "lo", 7200, "ts", "ap", {"n": F.lit(True), "floors": F.col("floor")})
    assert sorted(map(tuple, got.collect())) == [(1, 1, 4, 2), (2, 0, 0, 0), (3, 0, 1, 1)]


def test_the_next_other_of_equal_times(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    day = [0, 29, 0, 29, 0, 30, 1, 3, 1, 45, 2, 2]
    e = events(12, lambda i: start + dt.timedelta(days=day[i]), lambda i: (10, 10, 20, 20, 30, 30, 40, 40, 50, 50, 60, 11)[i])
    assert len(same_as_sql(spark, tmp_path, "join_self_range", events=e)) == 5
    assert ">= lo" not in plan_of(spark, "join_self_range")  # no pairs


def test_orders_without_a_date(spark, tmp_path):
    day = lambda n: n and dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    rows = [(1, 1), (1, 21), (1, None), (1, 60), (1, 60), (1, None), (2, None), (2, None), (3, None), (3, 5), (None, 4), (None, None)]
    orders = {"o_custkey": [c for c, _ in rows], "o_orderkey": list(range(12)), "o_orderdate": pa.array([day(n) for _, n in rows], pa.timestamp("us"))}
    assert len(same_as_sql(spark, tmp_path, "ts_interval_merge", orders=orders)) == 5  # the two of customer 2 are equal


def test_covered_times_of_a_network_are_few(spark):
    d = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
    rows = [("a", d(i), d(i + 2)) for i in range(48)] + [("a", d(60), d(61)), ("b", d(5), d(100)), ("b", d(30), d(31))]
    got = twin._times(spark.createDataFrame(rows, "network string, lo timestamp_ntz, hi timestamp_ntz"), "lo", "hi")
    assert sorted(map(tuple, got.collect())) == [("a", d(0), d(49)), ("a", d(60), d(61)), ("b", d(5), d(100))]
