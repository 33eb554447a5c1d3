"""Dashboards of networks, access points, channels and sensors over the domain's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import intervals, summaries
from tidemark.operators.stats import quantile
from tidemark.plans import networks as N
from tidemark.queries import _events, query
from tidemark.queries_domain import V, aps, at, excluded, hourly, levels, networks, notes, outages, periods, polls, readings, sensor_hours, spans

ZONE = "Europe/Bratislava"
_FROM, _TO = "2024-01-05", "2024-01-20"
_IN = f"hour >= timestamp '{_FROM}' and hour < timestamp '{_TO}'"


def _within(df, col="hour"):
    return df.where((F.col(col) >= at(_FROM)) & (F.col(col) < at(_TO)))


def _bucket(col="hour"):
    return (F.floor((S.micros(col) - S.micros(at(_FROM))) / 21_600_000_000) + 1).alias("bucket")


_BUCKET = f"(epoch_us(hour) - epoch_us(timestamp '{_FROM}')) // 21600000000 + 1"
_LOCAL = "hour + interval 1 hour"  # the zone's offset in January


@query("dash_networks", V + f"""
, seen as (select * from hourly join levels using (ap) where {_IN}), nhr as (select distinct network, {_LOCAL} as l from seen),
pr as (select network, count(*) as hours, count(*) filter (where hour(l) between 7 and 19) as day_hours, count(distinct l::date) filter (where hour(l) between 7 and 19) as days from nhr group by 1),
one as (select distinct ap, network, random, vendor, level from seen)
select network, count(*) as bssids, bool_and(random) as randomized, array_to_string(list_sort(list(distinct vendor)), ',') as vendors, min_by(level, case level when 'open' then 0 when 'legacy' then 1 when 'psk_no_mfp' then 2 else 3 end) as weakest,
 any_value(hours) as hours, any_value(day_hours) as day_hours, any_value(days) as days from one join pr using (network) group by 1""")
def dash_networks(t):
    return N.network_rows(_within(hourly(t)), levels(t), ZONE)


@query("ts_presence_label", V + f"""

, nhr as (select distinct network, {_LOCAL} as l from hourly join aps using (ap) where {_IN})
select network, case when count(*) >= 0.9 * 360 then 'permanent' when count(*) filter (where hour(l) between 7 and 19) >= 0.8 * count(*) and count(distinct l::date) filter (where hour(l) between 7 and 19) >= 3 then 'daytime' when count(*) <= 2 then 'transient' else 'intermittent' end as presence from nhr group by 1""")
def ts_presence_label(t):
    from tidemark.functions.decisions import presence_label

    rows = N.network_rows(_within(hourly(t)), levels(t), ZONE)
    return rows.select("network", presence_label(F.col("hours"), F.col("day_hours"), F.col("days"), F.lit(360)).alias("presence"))


_VERDICT = """
, vd as (select l.*, n.kind as net_kind, case when n.kind = 'managed' then case when expected is null then case when require_mfp and l.kind <> 'open' and not required then 'MFP not required' end
  when expected = 'enterprise' and l.kind <> 'enterprise' then 'not Enterprise' when expected = 'psk_or_better' and l.kind not in ('psk', 'enterprise', 'sae') then 'weaker than WPA2-PSK'
  when expected = 'wpa3' and not (l.kind = 'sae' or (l.kind = 'enterprise' and required)) then 'not WPA3' when require_mfp and not required then 'MFP not required' end end as reason from levels l join networks n using (network))
"""


@query("dash_network_bssids", V + _VERDICT + f"""
, r as (select ap, sensor, quantile_cont(median, 0.5) as rssi, max(hour) as last_hour from hourly where {_IN} group by 1, 2)
select ap, network, net_kind, level, reason, sensor, round(rssi, 1) as rssi, last_hour from vd join r using (ap)""")
def dash_network_bssids(t):
    r = _within(hourly(t)).groupBy("ap", "sensor").agg(F.round(quantile("median", 0.5), 1).alias("rssi"), F.max("hour").alias("last_hour"))
    return N.verdicts(levels(t), networks(t)).join(r, "ap").select("ap", "network", "net_kind", "level", "reason", "sensor", "rssi", "last_hour")


_SEEN = f", seen as (select {_BUCKET} as bucket, ap, min(hour) as lo, max(hour) + interval 1 hour as hi, max(hour) as last_hour from hourly where {_IN} group by 1, 2)"


def _seen(t):
    return _within(hourly(t)).groupBy(_bucket(), "ap").agg(F.min("hour").alias("lo"), (F.max("hour") + F.expr("interval 1 hour")).alias("hi"), F.max("hour").alias("last_hour"))


@query("dash_network_series", V + _SEEN + """
, lv as (select s.bucket, s.ap, coalesce(min(case p.level when 'open' then 0 when 'legacy' then 1 when 'strong' then 3 end), 99) as rank from seen s left join periods p on p.ap = s.ap and p.valid_from < s.hi and (p.valid_to is null or p.valid_to > s.lo) group by 1, 2),
net as (select bucket, network, bool_and(random) as mobile, min(rank) as rank from lv join aps using (ap) group by 1, 2)
select bucket, count(k.network) as configured, count(*) filter (where k.network is null and mobile) as mobile, count(*) filter (where k.network is null and not mobile) as other,
 count(*) filter (where rank = 0) as open, count(*) filter (where rank = 1) as legacy, count(*) filter (where rank = 3) as strong, count(*) filter (where rank = 99) as unknown from net left join networks k using (network) group by 1""")
def dash_network_series(t):
    lv = N.levels_in(_seen(t).drop("last_hour"), periods(t)).join(aps(t), "ap")
    net = lv.groupBy("bucket", "network").agg(F.min("random").alias("m"), F.min("rank").alias("rank")).join(networks(t).select("network", F.lit(True).alias("known")), "network", "left")
    known, n = F.col("known").isNotNull(), lambda c, name: F.count_if(c).alias(name)
    ranks = (n(F.col("rank") == r, name) for r, name in ((0, "open"), (1, "legacy"), (3, "strong"), (99, "unknown")))
    return net.groupBy("bucket").agg(n(known, "configured"), n(~known & F.col("m"), "mobile"), n(~known & ~F.col("m"), "other"), *ranks)


@query("dash_presence", V + _SEEN + """
, op as (select distinct s.bucket, s.ap from seen s join periods p on p.ap = s.ap and p.level = 'open' and p.valid_from < s.hi and (p.valid_to is null or p.valid_to > s.lo)),
fst as (select bucket, count(*) as n from (select ap, min(bucket) as bucket from seen group by 1) group by 1)
select bucket, count(*) filter (where not random) as fixed, count(*) filter (where random) as mobile, count(op.ap) as open, coalesce(any_value(fst.n), 0) as new from seen join aps using (ap) left join op using (bucket, ap) left join fst using (bucket) group by 1""")
def dash_presence(t):
    s = _seen(t).drop("last_hour")
    is_open = intervals.overlapping(s, periods(t).where("level = 'open'"), ["ap"], ("lo", "hi"), ("valid_from", "valid_to")).select("bucket", "ap").distinct().withColumn("o", F.lit(True))
    first = s.groupBy("ap").agg(F.min("bucket").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("new"))
    n = s.join(aps(t), "ap").join(is_open, ["bucket", "ap"], "left").groupBy("bucket").agg(F.count_if(~F.col("random")).alias("fixed"), F.count_if("random").alias("mobile"), F.count("o").alias("open"))
    return n.join(first, "bucket", "left").na.fill(0, ["new"])


@query("dash_fixed_entities", V + ", n as (select ap, max_by(sensor, (ts, id)) as sensor, max(ts) as ts from readings group by 1) select ap, network, sensor, ts from aps join n using (ap) where not random")
def dash_fixed_entities(t):
    newest = summaries.newest_of(readings(t), "ap", "ts", "id", ["sensor", "ts"])
    return aps(t).where("not random").join(newest, "ap").select("ap", "network", "sensor", "ts")


@query("dash_ap_rssi", V + """
, h as (select ap, hour, median, n_valid, n_floor from hourly join aps using (ap) where network = 'net3'), g as (select ap, unnest(generate_series(min(hour), max(hour), interval 1 hour)) as hour from h group by ap),
b as (select ap, quantile_cont(level, 0.05) as p5, quantile_cont(level, 0.95) as p95 from readings group by 1)
select ap, hour, median, coalesce(n_valid, 0) as n_valid, coalesce(n_floor, 0) as n_floor, p5, p95 from g left join h using (ap, hour) left join b using (ap)""")
def dash_ap_rssi(t):
    h = hourly(t).join(aps(t).where("network = 'net3'").select("ap"), "ap").select("ap", "hour", "median", "n_valid", "n_floor")
    edges = h.groupBy("ap").agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"))
    grid = edges.select("ap", F.explode(F.sequence("lo", "hi", F.expr("interval 1 hour"))).alias("hour"))
    band = readings(t).groupBy("ap").agg(quantile("level", 0.05).alias("p5"), quantile("level", 0.95).alias("p95"))
    return grid.join(h, ["ap", "hour"], "left").join(band, "ap", "left").na.fill(0, ["n_valid", "n_floor"])


@query("dash_ap_load", "select user_id as ap, isodow(ts) as weekday, hour(ts) as hour, max(k) as clients, round(avg(value), 6) as util, max(value) as peak from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events) group by 1, 2, 3")
def dash_ap_load(t):
    day = (F.weekday("ts") + 1).cast("long").alias("weekday")
    return _events(t).groupBy(F.col("user_id").alias("ap"), day, F.hour("ts").cast("long").alias("hour")).agg(F.max("k").alias("clients"), F.round(F.avg("value"), 6).alias("util"), F.max("value").alias("peak"))


_LOAD = ", load as (select user_id as ap, ts, k % 13 + 1 as channel, value as util from ev), prim as (select ap, channel from (select ap, channel, row_number() over (partition by ap order by count(*) desc, channel) as r from load group by ap, channel) where r = 1)"


def _load(t):
    return _events(t).select(F.col("user_id").alias("ap"), "ts", (F.col("k") % 13 + 1).alias("channel"), F.col("value").alias("util"))


@query("dash_spectrum", V + _LOAD + """
, ch as (select channel, count(distinct ap) as users, round(avg(util), 6) as util from load group by 1), own as (select channel, count(*) as aps from prim group by 1), ps as (select l.channel, count(distinct l.ap) as passing from load l join prim p using (ap) where p.channel <> l.channel group by 1)
select channel, coalesce(aps, 0) as aps, coalesce(passing, 0) as passing, util, channel not in (1, 6, 11) as overlaps from ch left join own using (channel) left join ps using (channel)""")
def dash_spectrum(t):
    load, prim = _load(t), N.primary(_load(t), "ap", "channel")
    own = prim.groupBy("channel").agg(F.count("*").alias("aps"))
    passing = load.join(prim.withColumnRenamed("channel", "p"), "ap").where("p <> channel").groupBy("channel").agg(F.count_distinct("ap").alias("passing"))
    ch = load.groupBy("channel").agg(F.round(F.avg("util"), 6).alias("util"))
    return ch.join(own, "channel", "left").join(passing, "channel", "left").na.fill(0, ["aps", "passing"]).withColumn("overlaps", ~F.col("channel").isin(1, 6, 11))


@query("dash_spectrum_issues", V + _LOAD + """
, c as (select ap, ts, channel, lag(channel) over (partition by ap order by ts) as before from load), r as (select ap, count(*) filter (where before <> channel)::double / count(distinct ts::date) as rate from c group by 1)
select network, count(*) as aps, quantile_cont(rate, 0.25) as q1, quantile_cont(rate, 0.5) as median, quantile_cont(rate, 0.75) as q3, count(*) filter (where p.channel not in (1, 6, 11)) as overlapping from r join aps using (ap) join prim p using (ap) group by 1 having quantile_cont(rate, 0.5) >= 0.5""")
def dash_spectrum_issues(t):
    w = Window.partitionBy("ap").orderBy("ts")
    c = _load(t).withColumn("before", F.lag("channel").over(w))
    rate = c.groupBy("ap").agg((F.count_if(F.col("before") != F.col("channel")) / F.count_distinct(F.to_date("ts"))).alias("rate"))
    each = rate.join(aps(t), "ap").join(N.primary(_load(t), "ap", "channel"), "ap")
    over = each.groupBy("network").agg(F.count_if(~F.col("channel").isin(1, 6, 11)).alias("overlapping"))
    return N.spread(each, ["network"], "rate").withColumnRenamed("n", "aps").join(over, "network").where("median >= 0.5")


@query("dash_utilization", V + _LOAD + """
, a as (select date_trunc('hour', ts) as hour, channel, ap, avg(util) as u from load group by 1, 2, 3), h as (select hour, channel, avg(u) as u, count(*) as aps from a group by 1, 2)
select hour(hour + interval 1 hour) as local_hour, channel, round(avg(u), 6) as util, max(u) as peak, sum(aps)::bigint as ap_hours from h group by 1, 2""")
def dash_utilization(t):
    a = _load(t).groupBy(F.date_trunc("hour", "ts").alias("hour"), "channel", "ap").agg(F.avg("util").alias("u"))
    h = a.groupBy("hour", "channel").agg(F.avg("u").alias("u"), F.count("*").alias("aps"))
    here = F.hour(N.local(F.col("hour"), ZONE)).cast("long").alias("local_hour")
    return h.groupBy(here, "channel").agg(F.round(F.avg("u"), 6).alias("util"), F.max("u").alias("peak"), F.sum("aps").alias("ap_hours"))


@query("dash_outages", V + f"""
select sensor, 'outage' as type, starts_at, ends_at, 'polls' as source from outages union all
select sensor, 'outage', starts_at, ends_at, 'annotation' from notes n where kind = 'gap' and not exists (select 1 from outages o where o.sensor = n.sensor and o.starts_at < coalesce(n.ends_at, n.starts_at + interval 1 microsecond) and o.ends_at > n.starts_at)
union all select sensor, 'excluded', lo, hi, 'discard' from excluded""")
def dash_outages(t):
    n = notes(t).where("kind = 'gap'").select("id", "sensor", F.col("starts_at").alias("lo"), F.coalesce("ends_at", F.col("starts_at") + F.expr("interval 1 microsecond")).alias("hi"), F.col("ends_at").alias("to_at"))
    covered = intervals.overlapping(n, outages(t), ["sensor"], ("lo", "hi"), ("starts_at", "ends_at")).select("id").distinct()
    row = lambda df, kind, lo, hi, source: df.select("sensor", F.lit(kind).alias("type"), F.col(lo).alias("starts_at"), F.col(hi).alias("ends_at"), F.lit(source).alias("source"))
    return row(outages(t), "outage", "starts_at", "ends_at", "polls").union(row(n.join(covered, "id", "left_anti"), "outage", "lo", "to_at", "annotation")).union(row(excluded(t), "excluded", "lo", "hi", "discard"))


@query("dash_settings_reads", V + ", a as (select network, count(*) as affected from aps group by 1) select network, kind, expected, require_mfp, coalesce(affected, 0) as affected from networks left join a using (network)")
def dash_settings_reads(t):
    n = aps(t).groupBy("network").agg(F.count("*").alias("affected"))
    return networks(t).join(n, "network", "left").na.fill(0, ["affected"])


@query("dash_context", V + "select cast(max(last_poll) as varchar) as latest, string_agg(sensor || ':' || strftime(first_poll, '%Y-%m-%d'), ',' order by sensor) as sensors, (select count(*) from sensor_hours) as hours from spans")
def dash_context(t):
    s = spans(t)
    label = F.concat_ws(":", F.col("sensor").cast("string"), F.date_format("first_poll", "yyyy-MM-dd"))
    head = s.agg(F.max("last_poll").cast("string").alias("latest"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sensor", label.alias("t")))), lambda x: x["t"]), ",").alias("sensors"))
    return head.join(F.broadcast(sensor_hours(t).agg(F.count("*").alias("hours"))))


@query("dash_clients_bucket", V + f"""
, cl as (select date_trunc('hour', ts) as hour, sum(c)::bigint as clients from (select ts, user_id, max(k) as c from ev where event_type = 'view' group by 1, 2) group by 1), cap as (select hour from sensor_hours where {_IN} group by 1 having sum(capture) > 0),
c as (select {_BUCKET} as bucket, count(*) as captured, count(cl.hour) as loaded from cap left join cl using (hour) group by 1), pk as (select {_BUCKET} as bucket, max(clients) as peak from cl where {_IN} group by 1)
select bucket, peak, case when captured > 0 then round(loaded::double / captured, 3) end as load_share from c full join pk using (bucket)""")
def dash_clients_bucket(t):
    each = _events(t).where("event_type = 'view'").groupBy("ts", "user_id").agg(F.max("k").alias("c"))
    cl = each.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.sum("c").alias("clients"))
    cap = _within(sensor_hours(t)).groupBy("hour").agg(F.sum("capture").alias("n")).where("n > 0").join(cl.select("hour", F.lit(1).alias("l")), "hour", "left")
    share = cap.groupBy(_bucket()).agg(F.round(F.count("l") / F.count("*"), 3).alias("load_share"))
    return share.join(_within(cl).groupBy(_bucket()).agg(F.max("clients").alias("peak")), "bucket", "full")


_DET = "(select event_id as id, user_id as ap, user_id % 3 as sensor, ts, event_type as type, value, case when event_id % 3 = 0 then 'closed' else 'open' end as status from ev where event_type in ('error', 'signup'))"


def _det(t):
    e = t("events").where("event_type in ('error', 'signup')")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("ap"), (F.col("user_id") % 3).alias("sensor"), "ts", F.col("event_type").alias("type"), "value", F.when(F.col("event_id") % 3 == 0, "closed").otherwise("open").alias("status"))


@query("dash_event_detail", V + f"select d.id, d.ts, d.type, d.status, a.network, l.level from {_DET} d left join aps a using (ap) left join levels l using (ap)")
def dash_event_detail(t):
    return _det(t).join(levels(t), "ap", "left").select("id", "ts", "type", "status", "network", "level")


@query("dash_who_saw_it", V + f"select d.id, r.sensor, count(*) as n_obs, quantile_cont(r.level, 0.5) as median from {_DET} d join readings r on r.ap = d.ap and r.ts >= d.ts - interval 1 hour and r.ts < d.ts + interval 1 hour group by 1, 2")
def dash_who_saw_it(t):
    hour = F.expr("interval 1 hour")
    d = _det(t).select("id", "ap", (F.col("ts") - hour).alias("lo"), (F.col("ts") + hour).alias("hi"))
    r = readings(t).select("ap", "sensor", "level", F.col("ts").alias("at"))
    return intervals.points_inside(r, d, ["ap"], "at", "lo", "hi").groupBy("id", "sensor").agg(F.count("*").alias("n_obs"), quantile("level", 0.5).alias("median"))


_LOG = f"(select id, ap, ts, status, lag(status) over (partition by ap, type order by ts, id) as old from {_DET})"


def _log(t):
    return _det(t).withColumn("old", F.lag("status").over(Window.partitionBy("ap", "type").orderBy("ts", "id")))


@query("dash_label_history", V + f"select ap, count(*) as changes, max(ts) as last_at, max_by(status, (ts, id)) as last_status from {_LOG} where old is not null and old <> status group by 1")
def dash_label_history(t):
    c = _log(t).where("old <> status")
    return c.groupBy("ap").agg(F.count("*").alias("changes"), F.max("ts").alias("last_at"), F.max_by("status", F.struct("ts", "id")).alias("last_status"))


@query("dash_export_labels", V + f"select d.id, d.ts, d.sensor, d.type, d.status, case when n.network is not null then a.ap end as ap, a.network from {_DET} d left join aps a using (ap) left join networks n using (network)")
def dash_export_labels(t):
    n = networks(t).select("network", F.lit(True).alias("known"))
    out = _det(t).join(aps(t).select("ap", "network"), "ap", "left").join(n, "network", "left")
    return out.select("id", "ts", "sensor", "type", "status", F.when(F.col("known") & F.col("network").isNotNull(), F.col("ap")).alias("ap"), "network")


@query("dash_export_history", V + f"select id as event_id, ts as at, old as old_status, status as new_status from {_LOG} where old is not null and old <> status")
def dash_export_history(t):
    return _log(t).where("old <> status").select(F.col("id").alias("event_id"), F.col("ts").alias("at"), F.col("old").alias("old_status"), F.col("status").alias("new_status"))


@query("ts_dataset_boundaries", V + "select sensor, strftime(starts_at, '%Y-%m-%d %H:%M') as at, label from notes where kind = 'hardware_change'")
def ts_dataset_boundaries(t):
    return notes(t).where("kind = 'hardware_change'").select("sensor", F.date_format("starts_at", "yyyy-MM-dd HH:mm").alias("at"), "label")


@query("ts_dataset_period", V + """
select 'polls' as metric, count(*)::double as value from polls union all select 'ok_share', round(count(*) filter (where ok)::double / count(*), 6) from polls union all select 'capture_hours', round(sum(capture_s) / 3600, 6) from captured
union all select 'outages', count(*) from outages union all select 'readings', count(*) from readings union all select 'floor_share', round(count(*) filter (where is_floor)::double / count(*), 6) from readings union all select 'aps', count(distinct ap) from readings""")
def ts_dataset_period(t):
    from tidemark.queries_domain import captured

    p = polls(t).agg(F.count("*").cast("double").alias("polls"), F.round(F.count_if("ok") / F.count("*"), 6).alias("ok_share"))
    r = readings(t).agg(F.count("*").cast("double").alias("readings"), F.round(F.count_if("is_floor") / F.count("*"), 6).alias("floor_share"), F.count_distinct("ap").cast("double").alias("aps"))
    c = captured(t).agg(F.round(F.sum("capture_s") / 3600, 6).alias("capture_hours"))
    o = outages(t).agg(F.count("*").cast("double").alias("outages"))
    rows = [df.unpivot([], df.columns, "metric", "value") for df in (p, r, c, o)]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


@query("ts_excluded_export", V + "select e.win as id, e.sensor, e.lo as excl_from, e.hi as excl_to, count(b.win) as batches from excl e left join batches b using (win) group by 1, 2, 3, 4")
def ts_excluded_export(t):
    from tidemark.queries_domain import batches, discarded

    n = batches(t).groupBy("window").agg(F.count("*").alias("batches"))
    return discarded(t).join(n, "window", "left").na.fill(0, ["batches"]).withColumnRenamed("window", "id")


@query("ts_heartbeats_export", V + "select id, sensor, ts, case when ts < timestamp '2024-01-15' then 'v1' else 'v2' end as era, exists (select 1 from excluded e where e.sensor = p.sensor and p.ts >= e.lo and (e.hi is null or p.ts < e.hi)) as excluded from polls p where capture")
def ts_heartbeats_export(t):
    p = polls(t).where("capture").select("id", "sensor", "ts")
    inside = intervals.points_inside(p, excluded(t), ["sensor"], "ts", "lo", "hi").select("id").distinct().withColumn("excluded", F.lit(True))
    era = F.when(F.col("ts") < at("2024-01-15"), "v1").otherwise("v2").alias("era")
    return p.join(inside, "id", "left").select("id", "sensor", "ts", era, F.coalesce("excluded", F.lit(False)).alias("excluded"))


@query("ts_uploads_export", "select o_orderkey as upload, o_orderdate as sent_at, count(l_linenumber) as rows, max(l_shipdate) as newest from orders left join lineitem on l_orderkey = o_orderkey group by 1, 2")
def ts_uploads_export(t):
    n = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("rows"), F.max("l_shipdate").alias("newest"))
    return t("orders").join(n, "o_orderkey", "left").select(F.col("o_orderkey").alias("upload"), F.col("o_orderdate").alias("sent_at"), F.coalesce("rows", F.lit(0)).alias("rows"), "newest")


@query("ts_refresh_export", V + "select sensor, ts::date as day, count(*) as runs, round(max((epoch_us(ts) - epoch_us(lo)) / 1e6), 3) as longest_s from (select *, hi as ts from gaps) where lo is not null group by 1, 2")
def ts_refresh_export(t):
    w = Window.partitionBy("sensor").orderBy("ts", "id")
    p = polls(t).withColumn("s", (S.micros("ts") - F.lag(S.micros("ts")).over(w)) / 1e6).where("s is not null")
    return p.groupBy("sensor", F.to_date("ts").alias("day")).agg(F.count("*").alias("runs"), F.round(F.max("s"), 3).alias("longest_s"))
