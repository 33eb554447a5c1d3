"""Thinned histories, protected names, calendars by zone, and lists as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import decisions as D
from tidemark.operators import calendar, inventory, names, stats, thin
from tidemark.queries import query
from tidemark.queries_domain import V, aps, at, readings


@query("st_heartbeat_thin", """
with recursive nx as (select a.user_id, a.event_id, min_by(b.event_id, (b.ts, b.event_id)) as next_id from events a join events b on a.user_id = b.user_id and epoch_us(b.ts) - epoch_us(a.ts) >= 21600000000 group by 1, 2),
kept as (select user_id, min_by(event_id, (ts, event_id)) as id from events group by 1 union all select kept.user_id, nx.next_id from kept join nx on nx.user_id = kept.user_id and nx.event_id = kept.id)
select kept.user_id, id, ts from kept join events on event_id = id""")
def st_heartbeat_thin(t):
    """Rows at least six hours after the last one kept, over an entity's whole history."""
    return thin.thinned(t("events").select("user_id", F.col("event_id").alias("id"), "ts"), ["user_id"], "ts", "id", 21_600)


_NAMED = """
, nm as (select ap, case ap % 9 when 0 then 'Net-' || (ap % 25) when 1 then 'nett' || (ap % 25) when 2 then null else network end as name, vendor as oui, kind as crypt, random from aps),
hist as (select ap, 'net' || (ap % 23) as name from aps where ap % 4 = 0), px(prefix, place) as (values ('net1', 1), ('NET2', 2), ('net13', 3)),
md as (select ap, quantile_cont(level, 0.5) as median, min(ts) >= timestamp '2024-01-03' as late from readings group by 1),
every as (select ap, name from nm union select ap, name from hist),
gr as (select ap, min_by(prefix, place) as prefix from every join px on starts_with(lower(name), lower(prefix)) group by 1),
g as (select nm.*, prefix, not starts_with(lower(coalesce(name, '')), lower(prefix)) as dropped, exists (select 1 from hist h where h.ap = nm.ap and h.name <> coalesce(nm.name, '')) as past, median, late from nm join gr using (ap) left join md using (ap)),
n as (select prefix, oui, count(*) as n from g group by 1, 2), own as (select prefix, oui from n where n = (select max(n) from n m where m.prefix = n.prefix)),
dc as (select prefix, arg_min(crypt, (-n, crypt)) as crypt from (select prefix, crypt, count(*) as n from g where crypt is not null group by 1, 2) group by 1), lv as (select prefix, quantile_cont(median, 0.5) as m, count(*) as size from g group by 1)
"""


def _named(t):
    k = F.col("ap")
    suffix = (k % 25).cast("string")
    name = F.when(k % 9 == 0, F.concat(F.lit("Net-"), suffix)).when(k % 9 == 1, F.concat(F.lit("nett"), suffix)).when(k % 9 != 2, F.col("network"))
    a = aps(t).select("ap", name.alias("name"), F.col("vendor").alias("oui"), F.col("kind").alias("crypt"), "random")
    history = aps(t).where("ap % 4 = 0").select("ap", F.concat(F.lit("net"), (k % 23).cast("string")).alias("name"))
    prefixes = a.sparkSession.createDataFrame([("net1", 1), ("NET2", 2), ("net13", 3)], "prefix string, place int")
    return a, history, prefixes


@query("ts_protected_flags", V + _NAMED + """
select g.ap, g.prefix, not exists (select 1 from own where own.prefix = g.prefix and own.oui = g.oui) as flag_oui, coalesce(late, false) as flag_late, coalesce(size > 1 and median >= m + 10, false) as flag_strong, coalesce(g.crypt <> dc.crypt, false) as flag_crypt, coalesce(random, false) as flag_rand, past and dropped as flag_dropped, past and not dropped as flag_adopted
from g join lv using (prefix) left join dc using (prefix)""")
def ts_protected_flags(t):
    """Seven flags of the access points that advertise, or once advertised, a protected name."""
    a, history, prefixes = _named(t)
    seen = readings(t).groupBy("ap").agg(stats.quantile("level", 0.5).alias("median"), (F.min("ts") >= at("2024-01-03")).alias("late"))
    return inventory.protected_flags(inventory.protected_groups(a, history, prefixes).join(seen, "ap", "left"))


@query("ts_look_alikes", V + _NAMED + r"""
, pl as (select ap, name, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') as p from nm where name <> '' and ap not in (select ap from gr)), pp as (select prefix, place, regexp_replace(lower(prefix), '[^a-z0-9]', '', 'g') as q from px)
select ap, name, min_by(prefix, place) as prefix from pl join pp on length(q) >= 3 and (starts_with(p, q) or (length(q) >= 4 and length(p) >= length(q) - 1 and levenshtein(p[:length(q)], q) <= 1)) group by 1, 2""")
def ts_look_alikes(t):
    """Names outside of the protected groups that only look like a protected one."""
    a, history, prefixes = _named(t)
    return inventory.look_alikes(a, inventory.protected_groups(a, history, prefixes), prefixes)


@query("join_similar_names", "select distinct a, b from (select distinct split_part(c_name, '#', 2) as a from customer) join (select distinct split_part(s_name, '#', 2) as b from supplier) on levenshtein(a, b) <= 1")
def join_similar_names(t):
    """Names of two tables that are at most one edit apart."""
    x, y = t("customer").select(F.split_part("c_name", F.lit("#"), F.lit(2)).alias("a")), t("supplier").select(F.split_part("s_name", F.lit("#"), F.lit(2)).alias("b"))
    return names.within_one_edit(x, y, "a", "b")


@query("fn_hop_stride", "select n, stride, n // gcd(n, stride) as visited from (select n, coalesce(list_filter(range(case when n < 4 then 1 else 4 end, greatest(n, case when n < 4 then 2 else 5 end)), lambda s: n % greatest(n // s, 1) <> 0)[1], 1) as stride from (select p_partkey as n from part))")
def fn_hop_stride(t):
    """Strides of lists of as many channels as there are parts, and what share they visit."""
    n = t("part").select(F.col("p_partkey").alias("n")).withColumn("stride", D.hop_stride(F.col("n")))
    return n.withColumn("visited", D.hop_visited(F.col("n"), F.lit(True), F.col("stride")))


# --- calendars -------------------------------------------------------------------------------------------------------

_ZONES = "(select *, case o_custkey % 3 when 0 then 'Europe/Bratislava' when 1 then 'America/New_York' else 'UTC' end as zone from orders)"


def _edges_sql(hours: int) -> str:
    """Edges in local wall time over each zone's span, as instants in UTC."""
    wall = "timezone(zone, timezone('UTC', {}(o_orderdate)))"
    series = f"generate_series(date_trunc('day', {wall.format('min')}), date_trunc('day', {wall.format('max')}) + interval 1 day, interval {hours} hour)"
    return f"(select zone, row_number() over (partition by zone order by w) as place, timezone('UTC', timezone(zone, w)) as edge from (select zone, unnest({series}) as w from {_ZONES} group by zone))"


def _zoned(t):
    k = F.col("o_custkey") % 3
    return t("orders").withColumn("zone", F.when(k == 0, "Europe/Bratislava").when(k == 1, "America/New_York").otherwise("UTC"))


def _edges(t, step: str):
    spans = _zoned(t).groupBy("zone").agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))
    return calendar.local_edges(spans, [], "lo", "hi", "zone", step)


@query("cal_buckets", f"select zone, place as bucket, edge as lo from {_edges_sql(6)}")
def cal_buckets(t):
    """Six-hour buckets of local time over the orders' years, changes of the clocks included."""
    return _edges(t, "6 hours").select("zone", F.col("place").cast("long").alias("bucket"), F.col("edge").alias("lo"))


@query("cal_local_days", f"select zone, cast(timezone(zone, timezone('UTC', edge)) as date) as day, edge as lo, lead(edge) over (partition by zone order by place) as hi, (epoch_us(lead(edge) over (partition by zone order by place)) - epoch_us(edge)) // 3600000000 as hours from {_edges_sql(24)} qualify hi is not null")
def cal_local_days(t):
    """Local days of each zone with their edges in UTC; days of a change have 23 or 25 hours."""
    e = _edges(t, "1 day")
    nxt = e.select("zone", (F.col("place") - 1).alias("place"), F.col("edge").alias("hi"))
    day = F.from_utc_timestamp(F.col("edge").cast("timestamp"), F.col("zone")).cast("date")
    hours = F.floor((F.unix_micros(F.col("hi").cast("timestamp")) - F.unix_micros(F.col("edge").cast("timestamp"))) / 3_600_000_000)
    return e.join(nxt, ["zone", "place"]).select("zone", day.alias("day"), F.col("edge").alias("lo"), "hi", hours.alias("hours"))


@query("cal_width_bucket", f"select o_orderkey, zone, count(edge) filter (where edge <= ts) as bucket from (select o_orderkey, zone, o_orderdate + to_hours(cast(o_orderkey % 24 as integer)) as ts from {_ZONES}) o left join (select zone as z, edge from {_edges_sql(24)}) e on e.z = o.zone group by 1, 2, ts having ts < max(edge)")
def cal_width_bucket(t):
    """The local day that holds each order, of some thousand edges a zone."""
    o = _zoned(t).select("o_orderkey", "zone", (F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))).alias("ts"))
    return calendar.bucket_by_edges(o, _edges(t, "1 day"), ["zone"], "ts").where("bucket is not null").drop("ts")


# --- lists as tables -------------------------------------------------------------------------------------------------


@query("src_array_params", "select r, cast(i as bigint) as place, s, e from (select n_regionkey as r, unnest(range(1, count(*) + 1)) as i, unnest(list(n_nationkey order by n_nationkey)) as s, unnest(list(n_name order by n_nationkey)) as e from nation group by 1)")
def src_array_params(t):
    """Two arrays a row, taken apart side by side with their places."""
    lists = t("nation").groupBy(F.col("n_regionkey").alias("r")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    z = F.arrays_zip(F.transform("x", lambda v: v["n_nationkey"]).alias("s"), F.transform("x", lambda v: v["n_name"]).alias("e"))
    return lists.select("r", F.posexplode(z).alias("p", "y")).select("r", (F.col("p") + 1).cast("long").alias("place"), "y.s", "y.e")


@query("src_values", "select v.status, v.label, count(o_orderkey) as n from (values ('F', 'finished'), ('O', 'open'), ('P', 'pending'), ('X', 'unheard of')) v(status, label) left join orders on o_orderstatus = v.status group by 1, 2")
def src_values(t):
    """A list of values that says which rows of a table are counted, and under what name."""
    o = t("orders")
    v = o.sparkSession.createDataFrame([("F", "finished"), ("O", "open"), ("P", "pending"), ("X", "unheard of")], "status string, label string")
    n = o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return v.join(n, "status", "left").select("status", "label", F.coalesce("n", F.lit(0)).alias("n"))
