"""Versioned tables, the ingest in its ten steps, cursors and marks, over the domain's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import ingest
from tidemark.queries import _EV, _events, query
from tidemark.queries_domain import V, aps, at, excluded, hourly, periods, polls, readings
from tidemark.session import shared_folder
from tidemark.sources.store import Change, Store
from tidemark.streaming import marks, merge_stream


def _store(t, name: str) -> Store:
    spark = t("events").sparkSession
    return Store(spark, shared_folder(spark, name))


def _by_day(rows, ts: str = "ts"):
    return rows.withColumn("day", F.to_date(ts))


@query("scan_brin", "select event_type, count(*) as n, max(ts) as newest from events where ts >= timestamp '2024-01-12' and ts < timestamp '2024-01-13' group by 1")
def scan_brin(t):
    """A time window of a table laid out by day: the other days' files are not read."""
    s = _store(t, "brin").commit({"events": Change(_by_day(t("events")), "day", ("user_id", "ts"))})
    inside = (F.col("ts") >= at("2024-01-12")) & (F.col("ts") < at("2024-01-13")) & (F.col("day") == F.lit("2024-01-12").cast("date"))
    return s.read("events").where(inside).groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").alias("newest"))


def _rollup(e):
    return e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("delete_insert_partition", f"select user_id, cast(ts as date) as day, count(*) as n, sum(k)::bigint as total from {_EV} group by 1, 2")
def delete_insert_partition(t):
    """A stored rollup of which the days that late rows touch are rebuilt and replaced, in one commit with the rows: the same as rebuilding all."""
    store, e = _store(t, "rollup"), _by_day(_events(t))
    late = F.col("event_id") % 7 == 3
    first = e.where(~late)
    v1 = store.commit({"events": Change(first, "day", ("user_id", "ts")), "daily": Change(_rollup(first), "day", ("user_id",))})
    days = ingest.touched(e.where(late), "day")
    rows = v1.part("events", days).unionByName(e.where(late))
    v2 = store.commit({"events": Change(rows, "day", ("user_id", "ts")), "daily": Change(_rollup(rows), "day", ("user_id",))}, v1)
    return v2.read("daily").select("user_id", "day", "n", "total")


@query("src_snapshot_export", """
select 'events' as "table", 1 as version, count(*) as n_rows, min(ts) as lo, max(ts) as hi from events where event_id % 5 > 0
union all select 'orders', 1, count(*), min(o_orderdate), max(o_orderdate) from orders""")
def src_snapshot_export(t):
    """A copy of two tables as of one version, taken while a later one is already there."""
    store = _store(t, "export")
    o = t("orders").withColumn("month", F.date_trunc("month", "o_orderdate").cast("date"))
    v1 = store.commit({"events": Change(_by_day(t("events")).where("event_id % 5 > 0"), "day", ("user_id",)), "orders": Change(o, "month", ("o_custkey",))})
    store.commit({"events": Change(_by_day(t("events")), "day", ("user_id",))})
    copy = f"{store.root}-copy"
    about = store.export(copy, v1.version).select("table", "version", "n_rows")
    spark = store.spark
    span = lambda name, ts: spark.read.parquet(f"{copy}/{name}").agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).select(F.lit(name).alias("table"), "lo", "hi")
    return about.join(F.broadcast(span("events", "ts").union(span("orders", F.col("o_orderdate").cast("timestamp_ntz")))), "table")


# --- the ingest ------------------------------------------------------------------------------------------------------


def _batch(t, which: str) -> dict:
    """A batch of all tables from the rows for which `which` holds (by a number x)."""
    x = lambda c: F.expr(which.replace("x", f"({c})"))
    a = aps(t).where(x("ap"))
    day = at("2024-01-01") + F.make_dt_interval(days=(F.col("ap") % 20).cast("int"))
    devices = a.select(
        (F.col("ap") % 3).alias("sensor"), F.col("ap").alias("device"), F.concat(F.lit("m"), F.col("ap")).alias("mac"), F.lit("ap").alias("type"), F.col("network").alias("ssid"), F.col("kind").alias("crypt"), (F.col("ap") % 13).cast("int").alias("channel"), F.col("vendor").alias("manuf"),
        day.alias("first_seen"), (day + F.expr("interval 5 days")).alias("last_seen"), day.alias("changed_at"), F.lit(1).cast("long").alias("cur_clients"), day.alias("cur_at"), (F.col("kind") != "open").alias("ever_ap"),
    )
    r = readings(t).where(x("id")).withColumnRenamed("ap", "device")
    sample = r.where("is_floor").select("sensor", "device", F.lit(0).alias("channel"), "ts", F.col("id").alias("clients"))
    loads = hourly(t).where(x("n_obs + ap")).select("sensor", F.col("ap").alias("device"), "hour", F.lit(0).alias("channel"), F.col("n_obs").alias("polls"), F.lit(0).cast("long").alias("clients_sum"), F.lit(0).cast("long").alias("clients_max"))
    o = t("orders").where(x("o_orderkey"))
    span = (F.min("o_orderdate").cast("timestamp_ntz").alias("first_seen"), F.max("o_orderdate").cast("timestamp_ntz").alias("last_seen"))
    sensor = (F.col("o_custkey") % 3).alias("sensor")
    return {
        "devices": devices,
        "polls": polls(t).where(x("id")).select("sensor", "id", "ts", "ok"),
        "device_history": periods(t).where(x("hour(valid_from)")).select((F.col("ap") % 3).alias("sensor"), F.col("ap").alias("device"), F.col("valid_from").alias("ts"), F.col("level").alias("crypt")),
        "observations": r.select("sensor", "device", "id", "ts", "level"),
        "load_hourly": loads,
        "load_samples": sample,
        "freq_hist": r.groupBy("sensor", "device", (F.col("id") % 4).alias("freq")).agg(F.count("*").alias("packets"), F.max("ts").alias("updated")),
        "associations": o.groupBy(sensor, F.col("o_custkey").alias("device"), F.col("o_orderpriority").alias("client")).agg(*span),
        "client_bssids": o.groupBy(sensor, F.col("o_orderpriority").alias("client"), F.col("o_custkey").alias("bssid")).agg(*span),
        "probes": o.groupBy(sensor, F.col("o_orderpriority").alias("client"), F.col("o_orderstatus").alias("ssid")).agg(*span),
        "alerts": polls(t).where(x("id")).where("not ok").select("sensor", (F.col("id") % 50_000).alias("hash"), "ts"),
    }


_KEYED = {  # step: table expression with the key's columns, its time, and x
    "devices": ("ap % 3 as sensor, ap as k1, 0 as k2, 0 as k3", "timestamp '2024-01-06' + to_days(cast(ap % 20 as integer))", "ap", "aps"),
    "polls": ("sensor, epoch_us(ts) as k1, 0 as k2, 0 as k3", "ts", "id", "polls"),
    "device_history": ("ap % 3 as sensor, ap as k1, epoch_us(valid_from) as k2, 0 as k3", "valid_from", "hour(valid_from)", "periods"),
    "observations": ("sensor, ap as k1, epoch_us(ts) as k2, 0 as k3", "ts", "id", "readings"),
    "alerts": ("sensor, id % 50000 as k1, 0 as k2, 0 as k3", "ts", "id", "(select * from polls where not ok)"),
}
_OUT = "not exists (select 1 from excluded e where e.sensor = r.sensor and {0} >= e.lo{1} and (e.hi is null or {0} < e.hi))"


_FIRST, _SECOND = "x % 3 > 0", "(x % 2 = 0 or x % 3 = 0)"


def _merge_sql() -> str:
    """Each step's counts for the snapshot (batch 1) and the live batch after it (batch 2)."""
    ctes, selects = [], []
    for step, (keys, ts, x, table) in _KEYED.items():
        ctes.append(f"r_{step} as (select {keys}, {ts} as tm, {x} as x from {table})")
        ctes.append(f"k_{step} as (select r.* from r_{step} r where {_OUT.format('r.tm', '')})")
    ctes.append("radio as (select ap % 3 as sensor, ap as k1 from aps where kind <> 'open')")
    ctes.append(f"d1 as (select sensor, k1 from k_devices where {_FIRST})")
    ctes.append(f"d2 as (select * from d1 union select sensor, k1 from k_devices join radio using (sensor, k1) where {_SECOND})")
    takes = {
        "polls": ("", ""), "alerts": ("", ""), "devices": ("", "join radio using (sensor, k1)"),
        "device_history": ("join d1 using (sensor, k1)", "join d2 using (sensor, k1) join radio using (sensor, k1)"), "observations": ("join d1 using (sensor, k1) join radio using (sensor, k1)", "join d2 using (sensor, k1) join radio using (sensor, k1)"),
    }
    for step in _KEYED:
        key = "sensor, k1, k2, k3"
        ctes.append(f"a_{step} as (select {key}, min(tm) as tm from k_{step} {takes[step][0]} where {_FIRST} group by all)")
        fresh = "" if step == "devices" else f"anti join a_{step} using ({key})"
        ctes.append(f"b_{step} as (select {key}, min(tm) as tm from k_{step} {takes[step][1]} {fresh} where {_SECOND} group by all)")
        for n, cond in ((1, _FIRST), (2, _SECOND)):
            got = f"(select count(*) from {'ab'[n - 1]}_{step})"
            kept = f"(select count(*) from k_{step} where {cond})"
            staged = f"(select count(*) from r_{step} where {cond})"
            selects.append(f"select {n} as batch, '{step}' as step, {staged} as staged, {staged} - {kept} as excluded, {got} as inserted, {kept} - {got} as conflicts, (select min(tm) from {'ab'[n - 1]}_{step}) as min_ts")
    return V + ", " + ", ".join(ctes) + " " + " union all ".join(selects)


@query("merge_all", _merge_sql())
def merge_all(t):
    """A snapshot, then a live batch, then the live batch again, through all ten steps: what each step did, for the tables that do not depend on another's counts."""
    store, windows = _store(t, "merge"), excluded(t)
    first = ingest.merge_batch(store, "s", 1, "snapshot", _batch(t, _FIRST), windows)
    second = ingest.merge_batch(store, "s", 2, "ingest", _batch(t, _SECOND), windows)
    again = ingest.merge_batch(store, "s", 2, "ingest", _batch(t, _SECOND), windows)
    out = first.withColumn("batch", F.lit(1)).union(second.withColumn("batch", F.lit(2))).union(again.withColumn("batch", F.lit(3)))
    return out.where(F.col("step").isin(*_KEYED))


# --- cursors and marks -----------------------------------------------------------------------------------------------

#: Rows arrive in four files; every seventh comes two files late.
_ARRIVALS = "(select *, user_id % 3 as sensor, (least(hour(ts) // 8 + case when event_id % 7 = 3 then 2 else 0 end, 3)) * 1000000000 + event_id as seq from events)"


def _arrivals(t, store: Store):
    file = F.least(F.floor(F.hour("ts") / 8) + F.when(F.col("event_id") % 7 == 3, 2).otherwise(0), F.lit(3))
    e = t("events").select("event_id", "ts", "value", (F.col("user_id") % 3).alias("sensor"), file.alias("file")).withColumn("seq", F.col("file") * 1_000_000_000 + F.col("event_id"))
    e.coalesce(8).write.partitionBy("file").parquet(f"{store.root}-landing")
    return e.drop("file").schema


def _landed(store: Store, schema, files: str):
    """An arrival as one micro-batch: its numbers are in no order over its files, so a part of it would move the cursor past rows of the rest."""
    return store.spark.readStream.schema(schema).parquet(f"{store.root}-landing/file={files}")


@query("st_cursor_resume", f"select sensor, max(seq) as seq, count(*) as n, max(ts) as ts from {_ARRIVALS} group by 1")
def st_cursor_resume(t):
    """A stream that takes in half of what arrives, then starts again without its checkpoint over all of it: each row is stored once, up to the cursor."""
    store = _store(t, "cursor")
    schema = _arrivals(t, store)
    for run, files in enumerate(("01", "0123")):
        for file in files:  # in order of arrival
            merge_stream.run_all(_landed(store, schema, file), marks.append_batch(store, "rows", "sensor", "seq", "ts"), f"{store.root}-run{run}-{file}")
    snap = store.snapshot()
    stored = snap.read("rows").groupBy("sensor").agg(F.count("*").alias("n"), F.max("ts").alias("ts"))
    at = store.spark.createDataFrame([(int(k), v) for k, v in marks.cursors(snap).items()], "sensor long, seq long")
    return stored.join(F.broadcast(at), "sensor")


@query("st_dirty_mark", "select user_id % 3 as sensor, cast(ts as date) as day, date_trunc('hour', ts) as hour, count(*) as n from events group by 1, 2, 3")
def st_dirty_mark(t):
    """Hourly counts kept by refreshes after each arrival, of the dirty days alone: the same as counting everything."""
    store = _store(t, "dirty")
    schema = _arrivals(t, store)
    hourly_counts = lambda e: e.groupBy("sensor", "day", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))
    for file in "0123":
        merge_stream.run_all(_landed(store, schema, file), marks.append_batch(store, "rows", "sensor", "seq", "ts"), f"{store.root}-run-{file}")
        marks.refresh(store, "rows", "hourly", "sensor", "ts", hourly_counts)
    return store.snapshot().read("hourly").select("sensor", "day", "hour", "n")


_POLLS = "(select event_id as id, user_id % 3 as sensor, ts, user_id as device, k % 20 as boot, value as mono, event_type in ('view', 'click') and k % 20 < 15 as synced, case when k % 17 > 0 then 200 - 3 * k end as level, k as clients, case when event_type = 'error' then k end as hash from ev)"


@query("upsert_poll_write", V + f"""
, pw as {_POLLS}, an as (select sensor, boot, min(id) as poll, min_by(mono, id) as m, min_by(epoch_us(ts) // 1000000, id) as w from pw where synced and mono is not null group by 1, 2),
ok as (select pw.*, an.w - an.m as epoch from pw left join an using (sensor, boot) where level is null or level between -128 and 127),
h as (select sensor, device, case when synced then date_trunc('hour', ts) else make_timestamp(cast(floor(floor(epoch + mono + 0.5) / 3600) as bigint) * 3600000000) end as hour, clients from ok where synced or (epoch is not null and mono is not null)),
al as (select sensor, hash, min(id) as id from pw where hash is not null group by 1, 2)
select sensor, (select count(*) from pw q where q.sensor = s.sensor) as polls, (select count(*) from ok where ok.sensor = s.sensor) as new_obs, (select count(*) from al where al.sensor = s.sensor) as new_alerts,
 (select count(*) from pw q where q.sensor = s.sensor and not (level is null or level between -128 and 127)) as skipped, (select count(*) from an where an.sensor = s.sensor) as anchors,
 (select count(*) from ok where ok.sensor = s.sensor and not synced and mono is not null and epoch is null) as waiting, (select count(distinct (device, hour)) from h where h.sensor = s.sensor) as hours, (select sum(clients)::bigint from h where h.sensor = s.sensor) as clients
from (select distinct sensor from pw) s""")
def upsert_poll_write(t):
    """Polls in two groups, the second sent twice: what is stored of them by sensor."""
    from tidemark.operators import poll_write

    store = _store(t, "polls")
    k = F.col("k")
    e = _events(t).select(
        F.col("event_id").alias("id"), (F.col("user_id") % 3).alias("sensor"), "ts", F.col("user_id").alias("device"), (k % 20).alias("boot"), F.col("value").alias("mono"), (F.col("event_type").isin("view", "click") & (k % 20 < 15)).alias("synced"),
        F.when(k % 17 > 0, 200 - 3 * k).alias("level"), k.alias("clients"), F.when(F.col("event_type") == "error", k).alias("hash"),
    )
    for seq, rows in ((1, e.where("ts < timestamp_ntz '2024-01-16'")), (2, e.where("ts >= timestamp_ntz '2024-01-16'")), (2, e.where("ts >= timestamp_ntz '2024-01-16'"))):
        poll_write.write_polls(store, "collector", seq, rows.select("sensor", "id", "ts", "boot", "mono", "synced"), rows.select("sensor", F.col("id").alias("poll"), "ts", "device", "level", "clients"), rows.where("hash is not null").select("sensor", F.col("id").alias("poll"), "hash"))
    s = store.snapshot()
    out = s.read("polls").groupBy("sensor").agg(F.count("*").alias("polls"), *(F.sum(c).alias(c) for c in ("new_obs", "new_alerts", "skipped")))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    for table, aggs in (("anchors", [F.count("*").alias("anchors")]), ("load_pending", [F.count("*").alias("waiting")]), ("load_hourly", [F.count("*").alias("hours"), F.sum("clients").alias("clients")])):
        out = out.join(s.read(table).groupBy("sensor").agg(*aggs), "sensor", "left")
    return out.select("sensor", "polls", "new_obs", "new_alerts", "skipped", zero("anchors"), zero("waiting"), zero("hours"), "clients")
