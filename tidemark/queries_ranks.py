"""Counts, quantiles and pages by places in an order, over the domain's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import ranks, stats
from tidemark.queries import query
from tidemark.queries_domain import ACCOUNT_APS, V, account_aps, at, hourly, polls, readings


@query("agg_percentile_cont", "select event_type, count(value) as n, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.9), 6) as p90 from events group by 1")
def agg_percentile_cont(t):
    q = ranks.quantiles(t("events"), ["event_type"], "value", {"median": 0.5, "p90": 0.9})
    return q.withColumns({c: F.round(c, 6) for c in ("median", "p90")})


@query("agg_describe", "select event_type, count(value) as n, round(avg(value), 6) as mean, round(median(value), 6) as median, round(quantile_cont(value, 0.1), 6) as p10, round(quantile_cont(value, 0.9), 6) as p90, min(value) as low, max(value) as high from events group by 1")
def agg_describe(t):
    q = ranks.quantiles(t("events"), ["event_type"], "value", {"median": 0.5, "p10": 0.1, "p90": 0.9}).drop("n")
    rest = t("events").groupBy("event_type").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    return rest.join(q.withColumns({c: F.round(c, 6) for c in ("median", "p10", "p90")}), "event_type", "left")


@query("ts_latency", "select l_returnflag, count(*) as n, round(quantile_cont(d, 0.5), 6) as p50, round(quantile_cont(d, 0.95), 6) as p95, round(quantile_cont(d, 0.99), 6) as p99 from (select l_returnflag, date_diff('day', o_orderdate, l_shipdate) as d from orders join lineitem on o_orderkey = l_orderkey) group by 1")
def ts_latency(t):
    j = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("l_returnflag", F.datediff("l_shipdate", "o_orderdate").alias("d"))
    q = ranks.quantiles(j, ["l_returnflag"], "d", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return q.withColumns({c: F.round(c, 6) for c in ("p50", "p95", "p99")})


_SEEN = """
, x as (select ap, sensor, count(level) as n, min(ts) as f, max(ts) as l, quantile_cont(level, 0.5) as med, min(level) as low, max(level) as high, count(distinct cast(ts as date)) as days from readings group by 1, 2),
pp as (select x.ap, count(q.id) as polls from x left join polls q on q.sensor = x.sensor and q.ts >= x.f and q.ts <= x.l and q.ok group by 1)
"""


def _seen(t):
    r = readings(t).groupBy("ap", "sensor").agg(F.count("level").alias("n"), F.min("ts").alias("f"), F.max("ts").alias("l"), stats.quantile("level", 0.5).alias("med"), F.min("level").alias("low"), F.max("level").alias("high"), F.count_distinct(F.to_date("ts")).alias("days"))
    n = ranks.points_between(r, polls(t).where("ok"), ["sensor"], "ap", "f", "l", "ts").withColumnRenamed("n", "polls")
    return r.join(n, "ap").withColumn("seen_pct", F.round(F.col("n") * 100.0 / F.greatest("polls", F.lit(1)), 6))


@query("ts_seen_pct", V + _SEEN + "select ap, n, polls, round(100.0 * n / greatest(polls, 1), 6) as seen_pct from x join pp using (ap)")
def ts_seen_pct(t):
    """Of each access point the share of its sensor's good polls, between its first and last reading, that read it."""
    return _seen(t).select("ap", "n", "polls", "seen_pct")


@query("an_strength", V + _SEEN + """
select ap, med, low, high, days, round(100.0 * n / greatest(polls, 1), 6) as seen_pct, case when med is null then 'no-rssi' when med >= -50 then 'close' else 'far' end as place,
 case when l - f < interval 30 minute or n < 10 then 'transient' when l - f >= interval 24 hour then 'sustained' else 'intermediate' end as class from x join pp using (ap)""")
def an_strength(t):
    """Access points with median, extremes, days, share of polls, distance and persistence."""
    span = F.col("l") - F.col("f")
    kind = F.when((span < F.expr("interval 30 minutes")) | (F.col("n") < 10), "transient").when(span >= F.expr("interval 24 hours"), "sustained").otherwise("intermediate")
    place = F.when(F.col("med").isNull(), "no-rssi").when(F.col("med") >= -50, "close").otherwise("far")
    return _seen(t).select("ap", "med", "low", "high", "days", "seen_pct", place.alias("place"), kind.alias("class"))


@query("page_offset", "select o_orderkey, o_totalprice, row_number() over (order by o_totalprice desc, o_orderkey) as place, count(*) over () as total, count(*) filter (where o_orderstatus = 'F') over () as finished, count(*) filter (where o_orderpriority < '3') over () as urgent from orders order by 3 limit 25 offset 50")
def page_offset(t):
    """The third page, the total and the facets of a search."""
    facets = {"finished": F.col("o_orderstatus") == "F", "urgent": F.col("o_orderpriority") < "3"}
    rows, about = ranks.page(t("orders"), [F.desc("o_totalprice"), "o_orderkey"], 3, 25, facets)
    return rows.select("o_orderkey", "o_totalprice", "place").join(F.broadcast(about))


_CLASSES = ("managed", "suspicious", "friendly", "ignored", "unknown")


def _list_sql(account: str) -> str:
    counts = ", ".join(f"count(*) filter (where class = '{c}') over () as n_{c}" for c in _CLASSES)
    return V + f""", acc as ({account}),
sb as (select ap, string_agg(sensor || ':' || coalesce(cast(round(m * 10) as bigint)::varchar, '-'), ',' order by m desc nulls last, sensor) as seen_by from (select ap, sensor, quantile_cont(median, 0.5) as m from hourly where hour >= timestamp '2024-01-10' and hour < timestamp '2024-01-17' group by 1, 2) group by 1),
lc as (select user_id as ap, max_by(k, (ts, event_id)) as clients, max_by({{'u': case when k % 3 = 0 then k % 2 end}}, (ts, event_id)).u as util from ev group by 1),
fo as (select ap, min(ts) as first_obs from readings group by 1),
a as (select acc.*, seen_by, lc.clients, lc.util, fo.first_obs >= timestamp '2024-01-10' as new from acc join sb using (ap) left join lc using (ap) left join fo using (ap) where starts_with(network, 'net1'))
select ap, network, class, level, seen_by, clients, util, new, row_number() over (order by network, ap) as place, count(*) over () as total, {counts}, count(*) filter (where level = 'open') over () as n_open, count(*) filter (where mobile) over () as n_hotspots, count(*) filter (where new) over () as n_new from a order by place limit 20 offset 20"""


def _ap_list(t):
    e = t("events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    h = hourly(t).where((F.col("hour") >= at("2024-01-10")) & (F.col("hour") < at("2024-01-17"))).groupBy("ap", "sensor").agg(stats.quantile("median", 0.5).alias("m"))
    text = F.concat(F.col("sensor").cast("string"), F.lit(":"), F.coalesce(F.round(F.col("m") * 10).cast("long").cast("string"), F.lit("-")))
    seen = h.groupBy("ap").agg(F.array_sort(F.collect_list(F.struct(F.coalesce(-F.col("m"), F.lit(float("inf"))).alias("o"), "sensor", text.alias("x")))).alias("s")).select("ap", F.array_join(F.transform("s", lambda s: s["x"]), ",").alias("seen_by"))  # one entry a sensor
    newest = F.struct("ts", "event_id")
    util = F.max_by(F.struct(F.when(F.col("k") % 3 == 0, F.col("k") % 2).alias("u")), newest)
    last = e.groupBy(F.col("user_id").alias("ap")).agg(F.max_by("k", newest).alias("clients"), util.alias("u")).select("ap", "clients", F.col("u.u").alias("util"))
    first = readings(t).groupBy("ap").agg(F.min("ts").alias("first_obs"))
    a = account_aps(t).join(seen, "ap").join(last, "ap", "left").join(first, "ap", "left").where(F.col("network").startswith("net1"))
    return a.withColumn("new", F.col("first_obs") >= at("2024-01-10"))


@query("dash_ap_list", _list_sql(ACCOUNT_APS))
def dash_ap_list(t):
    """The second page of a search, with what each access point's sensors hear, its clients and utilisation, and the facets of all that was found."""
    facets = {f"n_{c}": F.col("class") == c for c in _CLASSES} | {"n_open": F.col("level") == "open", "n_hotspots": F.col("mobile"), "n_new": F.col("new")}
    rows, about = ranks.page(_ap_list(t), ["network", "ap"], 2, 20, facets)
    return rows.select("ap", "network", "class", "level", "seen_by", "clients", "util", "new", "place").join(F.broadcast(about))
