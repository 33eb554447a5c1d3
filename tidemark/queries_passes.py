"""Passes over long histories by blocks with halos: the twin detector's run, and readers that go through entities in order."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import detect, twin
from tidemark.operators.stats import robust_spread
from tidemark.queries import _events, query
from tidemark.queries_domain import NOW, V, aps, at, readings
from tidemark.streaming import alarms

_RULES = twin.TwinRules(gap_s=86_400, shift=detect.ShiftRules(k=0.3, shift_floor=3.0, spread_k=0.8), persistence=4, persist_window_s=259_200, med_dev=8.0, high_dev=12.0, guard_s=3_600, close_dbm=-45.0, strong_db=5.0)

_RUN = V + """
, base as (select ap, any_value(md) as median, 1.4826 * quantile_cont(abs(level - md), 0.5) as robust_sd from (select ap, level::double as level, quantile_cont(level::double, 0.5) over (partition by ap) as md from readings where level is not null) group by 1),
fl as (select ap, count(level) as n_obs, count(*) filter (where is_floor) as n_floor from readings group by 1),
el as (select base.*, n_obs from base join fl using (ap) join aps using (ap) where not (random and ap % 3 > 0) and n_floor / (n_obs + n_floor) <= 0.35),
sc as (select id, ap, ts, level::double as level from readings where ts >= timestamp '2024-01-04' and ts < timestamp '2024-01-26'),
cm as (select sc.* from sc join el using (ap) where level is not null and ts >= timestamp '2024-01-06' and (ap % 2 > 0 or ts < timestamp '2024-01-22')),
w as (select id, ap, ts, list(level) over (partition by ap order by ts, id rows 9 preceding) as l from cm),
m as (select *, list_aggregate(l, 'median') as wm from w where len(l) = 10),
d as (select m.*, list_aggregate(list_transform(l, lambda x: abs(x - wm)), 'median') as mad, wm - median as dev, greatest(robust_sd, 1) as s from m join el using (ap)),
f0 as (select *, case when abs(dev) >= greatest(0.3 * s, 3) and mad >= greatest(0.8 * s, 6) then 'both' when abs(dev) >= greatest(0.3 * s, 3) then 'median_shift' when mad >= greatest(0.8 * s, 6) then 'spread_inflation' end as facet from d),
f as (select * from f0 where facet is not null and not exists (select 1 from events c where c.event_type = 'signup' and c.user_id = f0.ap and c.ts between f0.ts - interval 1 hour and f0.ts + interval 1 hour)),
g as (select *, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by ap order by ts, id)) > 86400000000 then 1 else 0 end as n from f),
e1 as (select *, sum(n) over (partition by ap order by ts, id rows unbounded preceding) as episode from g),
e2 as (select *, count(*) over (partition by ap, episode order by epoch_us(ts) range between 259200000000 preceding and current row) as c from e1),
ep as (select ap, episode, min(ts) as first_at, max(ts) as last_at, count(*) as n_windows, max(c) as most, arg_min(dev, (-abs(dev), ts, id)) as peak, max(mad) as spread_mad, bool_or(facet in ('both', 'median_shift')) as sh, bool_or(facet in ('both', 'spread_inflation')) as sp from e2 group by 1, 2 having max(c) >= 4),
ee as (select ep.*, case when sh and sp then 'both' when sh then 'median_shift' else 'spread_inflation' end as facet, case when peak > 0 then 'stronger' else 'weaker' end as direction, network, ap % 4 = 0 as trusted from ep join aps using (ap) where last_at >= timestamp '2024-01-05' and first_at < timestamp '2024-01-25'),
seen as (select ap, count(level) as win_obs, min(ts) as win_first, max(ts) as win_last, quantile_cont(level, 0.5) as win_median from sc group by 1),
ad as (select ap, network from aps union select ap, 'net' || (ap % 25) as network from aps where ap % 7 = 0),
ev0 as (select ad.ap, ad.network, vendor, kind, random, ap % 4 = 0 as trusted, win_obs, win_first, win_last, win_median from ad join (select * exclude (network) from aps) using (ap) left join seen using (ap)),
gr as (select network, quantile_cont(win_median, 0.5) as group_median from ev0 where trusted group by 1),
dm as (select network, arg_min(kind, (-n, kind)) as dominant from (select network, kind, count(*) as n from ev0 where trusted group by 1, 2) group by 1),
un as (select ev0.*, group_median, dominant, exists (select 1 from ev0 k where k.trusted and k.network = ev0.network and k.vendor = ev0.vendor) as vendor_known, kind = dominant as kind_matches, (epoch_us(win_last) - epoch_us(win_first)) / 1e6 as span_s,
  not random and ((epoch_us(win_last) - epoch_us(win_first)) / 1e6 >= 3600 or win_obs >= 20) as sustained, coalesce(win_median >= -45 or coalesce(win_median >= group_median + 5, false), false) as close,
  (select count(*) from ev a where a.event_type = 'error' and a.k = 1 and a.user_id = ev0.ap) as n_alerts from ev0 join gr using (network) left join dm using (network) where not trusted and win_obs > 0),
met as (select u.network, u.ap as u_ap, e.ap as e_ap, e.episode from un u join ee e on u.sustained and e.network = u.network and exists (select 1 from ad where ad.ap = e.ap and ad.network = e.network) and e.trusted and e.first_at <= u.win_last + interval 1 day and e.last_at >= u.win_first - interval 1 day),
fb as (select *, exists (select 1 from met where e_ap = ee.ap and met.episode = ee.episode) as corroborated from ee), fa as (select *, exists (select 1 from met where u_ap = un.ap and met.network = un.network) as corroborated from un where sustained)
"""
_SEVERITY = "case least({}, 4) when 1 then 'low' when 2 then 'medium' when 3 then 'high' else 'critical' end"


def _twin_findings(t):
    r = readings(t)
    base = robust_spread(r.where("level is not null").withColumn("level", F.col("level").cast("double")), ["ap"], "level").join(r.groupBy("ap").agg(F.count("level").alias("n_obs"), F.count_if("is_floor").alias("n_floor")), "ap")
    a = aps(t).select("ap", "network", "vendor", "kind", "random", (F.col("ap") % 3 == 0).alias("sibling"), (F.col("ap") % 4 == 0).alias("trusted"))
    past = a.where("ap % 7 = 0").select("ap", F.concat(F.lit("net"), (F.col("ap") % 25).cast("string")).alias("network"))
    hardware = a.select("ap", at("2024-01-06").alias("hw_from"), F.when(F.col("ap") % 2 == 0, at("2024-01-22")).alias("hw_to"))
    e = t("events")
    changes = e.where("event_type = 'signup'").select(F.col("user_id").alias("ap"), F.col("ts").alias("at"))
    alerts = e.where("event_type = 'error' and get_json_object(props, '$.k') = '1'").select(F.col("user_id").alias("ap"), F.col("event_id").alias("alert_id"))
    return twin.twin_run(r.select("id", "ap", "ts", F.col("level").cast("double").alias("level")), base, a, a.select("ap", "network").union(past), hardware, changes, alerts, datetime(2024, 1, 5), datetime(2024, 1, 25), _RULES)


@query("det_twin_run", _RUN + f"""
select 'b' as signal, ap, network, first_at as ts, last_at as ts_end, {_SEVERITY.format("case when abs(peak) >= 12 then 3 when abs(peak) >= 8 then 2 else 1 end + (direction = 'stronger' and trusted)::int + corroborated::int")} as severity from fb
union all select 'a', ap, network, win_first, win_last, {_SEVERITY.format("case when vendor_known and kind_matches then 1 else 2 end + close::int + corroborated::int")} from fa""")
def det_twin_run(t):
    """Findings of both signals over a window of time."""
    return _twin_findings(t)[0].drop("evidence")


@query("det_evidence_twin", _RUN + """
select 'b' as signal, ap, first_at as ts, corroborated, facet, direction, n_windows, most, null as win_obs, null as close, null as alerts from fb
union all select 'a', ap, win_first, corroborated, null, null, null, null, win_obs, close, n_alerts from fa""")
def det_evidence_twin(t):
    """What the findings' evidence says, read back from its JSON."""
    schema = "rules struct<rssi_deviation boolean, unknown_bssid boolean>, observed struct<facet string, direction string, n_windows long, most long, close boolean>, membership struct<win_obs long, alert_ids array<long>>"
    f = _twin_findings(t)[0].withColumn("x", F.from_json("evidence", schema))
    is_a = F.col("signal") == "a"
    corroborated = F.when(is_a, F.col("x.rules.rssi_deviation")).otherwise(F.col("x.rules.unknown_bssid"))
    alerts = F.when(is_a, F.size("x.membership.alert_ids").cast("long"))
    return f.select("signal", "ap", "ts", corroborated.alias("corroborated"), "x.observed.facet", "x.observed.direction", "x.observed.n_windows", "x.observed.most", "x.membership.win_obs", "x.observed.close", alerts.alias("alerts"))


@query("scan_stream_cursor", "select user_id, event_id, row_number() over w as place, lag(event_id) over w as before_event_id from events window w as (partition by user_id order by ts, event_id)")
def scan_stream_cursor(t):
    """Each entity's rows in the order in which a reader goes through them once, by day."""
    return twin.pass_in_order(t("events").select("user_id", "event_id", "ts"), ["user_id"], "ts", "event_id", ["event_id"]).select("user_id", "event_id", "place", "before_event_id")


@query("notify_transitions", V + """
, c as (select user_id % 3 as sensor, event_id as id, ts as t, k % 5 = 0 as capturing, k % 11 = 0 as discarding, k / 2.0 as free from ev),
l as (select *, max(case when capturing then t end) over (partition by sensor order by t, id rows unbounded preceding) as cap from c),
f as (select *, not discarding and (cap is null or t > cap + interval 30 minute) as con, coalesce(free < 10, false) as don from l),
g as (select *, coalesce(lag(con) over w, false) as bc, coalesce(lag(don) over w, false) as bd, lag(t) over w as b, coalesce(t > lag(t) over w + interval 30 minute, false) as silent from f window w as (partition by sensor order by t, id)),
z as (select sensor, max_by(con, (t, id)) as con, max(t) as t from f group by 1 having max(t) + interval 30 minute < timestamp '2024-01-31 12:00:00'),
tr as (select sensor, 'contact' as alarm, b + interval 30 minute as t, 'start' as change from g where silent union all select sensor, 'contact', t, 'resolve' from g where silent union all select sensor, 'capture', b + interval 30 minute, 'resolve' from g where silent and bc
 union all select sensor, 'capture', t, 'start' from g where con and (silent or not bc) union all select sensor, 'capture', t, 'resolve' from g where not silent and bc and not con union all select sensor, 'disk', t, 'start' from g where don and not bd union all select sensor, 'disk', t, 'resolve' from g where not don and bd
 union all select sensor, 'contact', t + interval 30 minute, 'start' from z union all select sensor, 'capture', t + interval 30 minute, 'resolve' from z where con)
select sensor, alarm, t as at, change, case when change = 'resolve' then (epoch_us(t) - epoch_us(lag(t) over (partition by sensor, alarm order by t, change desc))) / 1e6 end as lasted_s from tr""")
def notify_transitions(t):
    """When each sensor's alarms start and resolve, from its whole history; the stream of the same is in tidemark.streaming."""
    k = F.col("k")
    c = _events(t).select((F.col("user_id") % 3).alias("sensor"), F.col("event_id").alias("id"), F.col("ts").alias("at"), (k % 5 == 0).alias("capturing"), (k % 11 == 0).alias("discarding"), (k / 2.0).alias("free_gb"))
    return alarms.alarm_history(c, 1_800, 10.0, at(NOW))
