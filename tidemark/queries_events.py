"""More operators bound to the generic tables: detectors, evaluation, dashboards, clocks, sequences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import detect, intervals, rollup, series, stats
from tidemark.plans import dashboards
from tidemark.queries import _EV, _events, query

_W = "window w as (partition by user_id order by ts, event_id)"


@query("det_deauth_scan", f"select event_id, round(since_s, 3) as since_s from (select event_id, k, lag(k) over w as b, (epoch_us(ts) - epoch_us(lag(ts) over w)) / 1e6 as since_s from {_EV} {_W}) where k <> b and k > 0 and since_s <= 3600")
def det_deauth_scan(t):
    return detect.counter_bursts(_events(t), ["user_id"], "ts", "event_id", "k", 3600).select("event_id", F.round("since_s", 3).alias("since_s"))


_TWIN = """
b as (select user_id, median(value) as md from events group by 1), r as (select user_id, any_value(md) as md, 1.4826 * median(abs(value - md)) as sd from events join b using (user_id) group by 1),
w as (select user_id, event_id, ts, list(value) over (partition by user_id order by ts, event_id rows 9 preceding) as l from events),
m as (select user_id, event_id, ts, l, list_aggregate(l, 'median') as wm from w where len(l) = 10),
d as (select m.*, list_aggregate(list_transform(l, lambda x: abs(x - wm)), 'median') as mad, wm - md as dev, greatest(sd, 1) as s from m join r using (user_id)),
f as (select user_id, event_id, ts, dev, case when abs(dev) >= greatest(0.5 * s, 8) and mad >= greatest(0.8 * s, 6) then 'both' when abs(dev) >= greatest(0.5 * s, 8) then 'median_shift' when mad >= greatest(0.8 * s, 6) then 'spread_inflation' end as facet from d)"""


def _twin(t):
    base = stats.robust_spread(t("events"), ["user_id"], "value")
    return detect.shifted_windows(t("events"), ["user_id"], ["ts", "event_id"], "value", base, detect.ShiftRules(k=0.5, spread_k=0.8))


@query("det_twin_windows", f"with {_TWIN} select event_id, round(dev, 6) as dev, facet from f where facet is not null")
def det_twin_windows(t):
    return _twin(t).select("event_id", F.round("dev", 6).alias("dev"), "facet")


@query("det_twin_eligibility", "select user_id, case when user_id % 11 = 0 then 'random_bssid' when f::double / (n + f) > 0.2 then 'floor_share' end as reason from (select user_id, count(*) filter (where event_type <> 'error') as n, count(*) filter (where event_type = 'error') as f from events group by 1)")
def det_twin_eligibility(t):
    b = t("events").groupBy("user_id").agg(F.count_if(F.col("event_type") != "error").alias("n"), F.count_if(F.col("event_type") == "error").alias("f"))
    return detect.eligibility(b, "n", "f", F.col("user_id") % 11 == 0, 0.2).select("user_id", "reason")


@query("det_twin_guard", f"with {_TWIN} select event_id from f where facet is not null and not exists (select 1 from events c where c.event_type = 'signup' and c.user_id = f.user_id and c.ts between f.ts - interval 6 hour and f.ts + interval 6 hour)")
def det_twin_guard(t):
    changes = t("events").where("event_type = 'signup'").select("user_id", F.col("ts").alias("at"))
    return detect.outside_guard(_twin(t).select("user_id", "event_id", "ts"), changes, ["user_id"], "ts", "at", 21600).select("event_id")


@query("det_twin_episode", f"""
with {_TWIN}, g as (select *, case when epoch_us(ts) - epoch_us(lag(ts) over w) > 86400000000 then 1 else 0 end as n from f where facet is not null {_W}),
e as (select *, sum(n) over (partition by user_id order by ts, event_id rows unbounded preceding) as episode from g),
c as (select *, count(*) over (partition by user_id, episode order by epoch_us(ts) range between 259200000000 preceding and current row) as m from e)
select user_id, cast(episode as bigint) as episode, min(ts) as first_at, max(ts) as last_at, count(*) as n, round(arg_max(dev, (abs(dev), epoch_us(ts), event_id)), 6) as peak,
 case when arg_max(dev, (abs(dev), epoch_us(ts), event_id)) >= 0 then 'stronger' else 'weaker' end as direction from c group by 1, 2 having max(m) >= 4""")
def det_twin_episode(t):
    return detect.deviating_episodes(_twin(t), ["user_id"], "ts", "event_id", 86400, 4, 259200).withColumn("peak", F.round("peak", 6))


@query("det_eval_match", """
with tr as (select o_orderkey as trial_id, o_custkey as user_id, timestamp '2024-01-01' + to_hours(cast(o_orderkey % 700 as integer)) as start_at from orders),
m as (select trial_id, event_id, row_number() over (partition by trial_id order by value desc nulls last, ts, event_id) as k, (epoch_us(ts) - epoch_us(start_at)) / 1e6 as latency
 from tr join events e on e.user_id = tr.user_id and e.ts <= start_at + interval 13 hour and e.ts >= start_at - interval 1 hour)
select tr.trial_id, event_id as detection_id, round(latency, 3) as latency_s from tr left join (select * from m where k = 1) m using (trial_id)""")
def det_eval_match(t):
    start = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("o_orderkey") % 700).cast("int"))
    trials = t("orders").select(F.col("o_orderkey").alias("trial_id"), F.col("o_custkey").alias("user_id"), start.alias("start_at"))
    trials = trials.withColumn("stop_at", F.col("start_at") + F.expr("interval 12 hours"))
    found = t("events").select("user_id", "ts", F.col("ts").alias("ts_end"), F.col("value").alias("severity_rank"), F.col("event_id").alias("detection_id"))
    return detect.matched_trials(trials, found, "user_id", 3600, 3600).select("trial_id", "detection_id", F.round("latency_s", 3).alias("latency_s"))


@query("det_trial_overlaps", "select o_custkey, o_orderkey from (select o_custkey, o_orderkey, o_orderdate, lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) as nx from orders) where nx < o_orderdate + interval 20 day")
def det_trial_overlaps(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = t("orders").withColumn("nx", F.lead("o_orderdate").over(w))
    return o.where(F.col("nx") < F.col("o_orderdate") + F.expr("interval 20 days")).select("o_custkey", "o_orderkey")


@query("det_clean_hours", "select date_trunc('hour', ts) as hour, count(*) as n from events e where not exists (select 1 from events a where a.user_id = e.user_id and a.event_type = 'error' and e.ts >= a.ts - interval 1 hour and e.ts < a.ts + interval 1 hour) group by 1")
def det_clean_hours(t):
    bad = t("events").where("event_type = 'error'").select("user_id", (F.col("ts") - F.expr("interval 1 hour")).alias("lo"), (F.col("ts") + F.expr("interval 1 hour")).alias("hi"))
    clean = intervals.points_outside(t("events"), bad, ["user_id"], "ts", "lo", "hi")
    return clean.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))


@query("det_hop_penalty", "select o_orderpriority, round(avg(o_totalprice) filter (where o_orderstatus = 'F') - avg(o_totalprice) filter (where o_orderstatus = 'O'), 4) as penalty from orders group by 1")
def det_hop_penalty(t):
    p = t("orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O"]).agg(F.avg("o_totalprice"))
    return p.select("o_orderpriority", F.round(F.col("F") - F.col("O"), 4).alias("penalty"))


@query("evidence_refresh", """
with s as (select event_id as id, user_id, ts, ts + interval 2 hour as te, event_type as label from events where event_id % 2 = 0), f as (select event_id as id, user_id, ts, ts + interval 1 hour as te from events where event_id % 2 = 1),
j as (select f.id, s.id as sid, s.label, row_number() over (partition by f.id order by s.ts, s.id) as k from f join s on s.user_id = f.user_id and f.ts <= s.te + interval 600 second and f.te >= s.ts - interval 600 second)
select f.id, case when j.id is null then 'insert' else 'refresh' end as action, sid as stored_id, label from f left join (select * from j where k = 1) j using (id)""")
def evidence_refresh(t):
    e = t("events").withColumnRenamed("event_id", "id")
    stored = e.where("id % 2 = 0").select("id", "user_id", "ts", (F.col("ts") + F.expr("interval 2 hours")).alias("ts_end"), F.col("event_type").alias("label"))
    found = e.where("id % 2 = 1").select("id", "user_id", "ts", (F.col("ts") + F.expr("interval 1 hour")).alias("ts_end"))
    return detect.refreshed_findings(stored, found, ["user_id"], 600)


@query("widen_scan", "select user_id, min(ts) as lo, max(ts + interval 2 hour) as hi from events where event_type = 'error' and ts < timestamp '2024-01-11' and ts + interval 2 hour > timestamp '2024-01-10' group by 1")
def widen_scan(t):
    e = t("events").where("event_type = 'error'").withColumn("end", F.col("ts") + F.expr("interval 2 hours"))
    touched = e.where((F.col("ts") < F.lit("2024-01-11").cast("timestamp_ntz")) & (F.col("end") > F.lit("2024-01-10").cast("timestamp_ntz")))
    return touched.groupBy("user_id").agg(F.min("ts").alias("lo"), F.max("end").alias("hi"))


# --- dashboards ------------------------------------------------------------------------------------------------------


@query("dash_events_bucket", """
with r as (select date_trunc('day', ts) as bucket, event_id, value, row_number() over (partition by date_trunc('day', ts) order by value desc, event_id) as k from events)
select bucket, count(*) as n, string_agg(cast(event_id as varchar), ',' order by k) filter (where k <= 5) as worst from r group by 1""")
def dash_events_bucket(t):
    return dashboards.events_per_bucket(t("events"), F.date_trunc("day", "ts"), "value", "event_id", 5)


@query("dash_event_feed", """
select case when event_type in ('view', 'click') then cast(user_id as varchar) || '|' || event_type || '|' || cast(cast(ts as date) as varchar) else '#' || cast(event_id as varchar) end as row_key,
 max(ts) as newest, max(event_id) as newest_id, count(*) as members, min(ts) as oldest from events group by 1""")
def dash_event_feed(t):
    return dashboards.feed(t("events"), F.col("event_type").isin("view", "click"), ["user_id", "event_type"], "ts", "event_id")


@query("dash_event_counts", "select event_type, count(*) as n, count(distinct user_id) as rows_ from events group by 1")
def dash_event_counts(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("rows_"))


@query("ts_availability_daily", f"""
with g as (select * from (select user_id, lag(ts) over w as a, ts as b from events {_W}) where epoch_us(b) - epoch_us(a) > 86400000000),
d as (select *, unnest(generate_series(cast(a as date)::timestamp, b, interval 1 day)) as day from g)
select user_id, cast(day as date) as day, round(1 - sum(greatest(least(epoch_us(b), epoch_us(day) + 86400000000) - greatest(epoch_us(a), epoch_us(day)), 0) / 1e6) / 86400, 6) as available from d group by 1, 2""")
def ts_availability_daily(t):
    g = series.gaps(t("events"), ["user_id"], "ts", "event_id", 86400)
    return dashboards.daily_availability(g, ["user_id"], "start_at", "end_at").withColumn("available", F.round("available", 6))


# --- clocks, sequences, presence -------------------------------------------------------------------------------------


@query("ts_contact_gaps", f"""
select user_id, ts as from_at, nx as to_at, round((epoch_us(coalesce(nx, timestamp '2024-02-01')) - epoch_us(ts)) / 1e6, 3) as seconds from (select user_id, ts, lead(ts) over w as nx from events {_W})
where epoch_us(coalesce(nx, timestamp '2024-02-01')) - epoch_us(ts) > 172800000000""")
def ts_contact_gaps(t):
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    g = t("events").select("user_id", F.col("ts").alias("from_at"), F.lead("ts").over(w).alias("to_at"))
    g = g.withColumn("seconds", (S.micros(F.coalesce(F.col("to_at"), now)) - S.micros("from_at")) / 1e6)
    return g.where("seconds > 172800").withColumn("seconds", F.round("seconds", 3))


@query("ts_seq_gaps", f"""
select event_id, case when k < b then 'seq_reused' when k > b + 1 then 'missing' end as kind, case when k > b + 1 then k - b - 1 end as missing from (select event_id, k, lag(k) over w as b from {_EV} {_W}) where k < b or k > b + 1""")
def ts_seq_gaps(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _events(t).withColumn("b", F.lag("k").over(w)).where("k < b or k > b + 1")
    jump = F.col("k") > F.col("b") + 1
    return e.select("event_id", F.when(F.col("k") < F.col("b"), "seq_reused").when(jump, "missing").alias("kind"), F.when(jump, F.col("k") - F.col("b") - 1).alias("missing"))


@query("ts_new_observation", f"select event_id from (select event_id, k, lag(k) over w as b from {_EV} {_W}) where b is null or k > b")
def ts_new_observation(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _events(t).withColumn("b", F.lag("k").over(w)).where("b is null or k > b").select("event_id")


@query("ts_sightings", f"""
with f as (select *, case when epoch_us(ts) - epoch_us(lag(ts) over w) > 21600000000 then 1 else 0 end as n from events {_W}),
e as (select *, sum(n) over (partition by user_id order by ts, event_id rows unbounded preceding) as g from f),
s as (select user_id, g, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as sec from e group by 1, 2)
select user_id, count(*) as sightings, round(median(sec), 4) as median_s from s group by 1""")
def ts_sightings(t):
    e = series.episodes(t("events"), ["user_id"], "ts", "event_id", 6 * 3600)
    return e.groupBy("user_id").agg(F.count("*").alias("sightings"), F.round(stats.quantile("seconds", 0.5), 4).alias("median_s"))


@query("ts_last_config_change", """
with c as (select o_custkey, o_orderdate, o_orderkey, o_orderstatus, lag(o_orderstatus) over (partition by o_custkey order by o_orderdate, o_orderkey) as b from orders)
select o_custkey, count(*) as n_changes, max(o_orderdate) as last_change_at, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) as last_state from c where b <> o_orderstatus group by 1""")
def ts_last_config_change(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    c = t("orders").withColumn("b", F.lag("o_orderstatus").over(w)).where("b <> o_orderstatus")
    return c.groupBy("o_custkey").agg(F.count("*").alias("n_changes"), F.max("o_orderdate").alias("last_change_at"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("last_state"))


@query("ts_hourly_profile", "select hour(first) as hour, count(*) as n, count(*) filter (where user_id % 4 = 2) as local from (select user_id, min(ts) as first from events group by 1) group by 1")
def ts_hourly_profile(t):
    f = t("events").groupBy("user_id").agg(F.min("ts").alias("first"))
    return f.groupBy(F.hour("first").cast("long").alias("hour")).agg(F.count("*").alias("n"), F.count_if(F.col("user_id") % 4 == 2).alias("local"))


@query("ts_lifetime_class", "select user_id, case when s < 864000 then 'transient' when s < 2419200 then 'intermediate' else 'sustained' end as lifetime from (select user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as s from events group by 1)")
def ts_lifetime_class(t):
    s = (S.micros(F.max("ts")) - S.micros(F.min("ts"))) / 1e6
    g = t("events").groupBy("user_id").agg(s.alias("s"))
    return g.select("user_id", F.when(F.col("s") < 864000, "transient").when(F.col("s") < 2419200, "intermediate").otherwise("sustained").alias("lifetime"))


@query("ts_channel_segments", f"""
with c as (select *, case when k // 25 is distinct from lag(k // 25) over w then 1 else 0 end as ch from {_EV} {_W}), r as (select *, sum(ch) over (partition by user_id order by ts, event_id rows unbounded preceding) as g from c),
s as (select user_id, g, any_value(k // 25) as channel, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as dwell from r group by 1, 2)
select user_id, channel, count(*) as visits, round(sum(dwell), 3) as dwell_s from s group by 1, 2""")
def ts_channel_segments(t):
    e = _events(t).withColumn("channel", F.expr("k div 25"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = e.withColumn("new", ~F.col("channel").eqNullSafe(F.lag("channel").over(w)))
    s = series.islands(new, ["user_id"], ["ts", "event_id"], F.col("new"), "g").groupBy("user_id", "g").agg(F.first("channel").alias("channel"), ((S.micros(F.max("ts")) - S.micros(F.min("ts"))) / 1e6).alias("dwell"))
    return s.groupBy("user_id", "channel").agg(F.count("*").alias("visits"), F.round(F.sum("dwell"), 3).alias("dwell_s"))


@query("ts_rule_cause", "select doc_id, case when toxic = 1 then 'label' when quality = 0 then 'quality' else 'none' end as cause from labels")
def ts_rule_cause(t):
    return t("labels").select("doc_id", F.when(F.col("toxic") == 1, "label").when(F.col("quality") == 0, "quality").otherwise("none").alias("cause"))


@query("ts_dataset_alerts", "select event_type, count(*) as n, min(ts) as first_at, max(ts) as last_at from events group by 1")
def ts_dataset_alerts(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query("ts_timeline", "select event_id, epoch_us(ts) // 1000000 as at_s from events where event_type <> 'error'")
def ts_timeline(t):
    return t("events").where("event_type <> 'error'").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at_s"))


@query("ts_typical", f"select user_id, round(median(m), 6) as typical from (select user_id, date_trunc('hour', ts) as h, median(value) as m from events group by 1, 2) group by 1")
def ts_typical(t):
    h = rollup.hourly(t("events"), "user_id", "ts", "value", F.lit(False))
    return h.groupBy("user_id").agg(F.round(stats.quantile("median", 0.5), 6).alias("typical"))


@query("ts_discarded_seqs", "select o_custkey, count(*) as seqs from (select distinct o_custkey, unnest(range(o_orderkey % 50, o_orderkey % 50 + 10)) as s from orders) group by 1")
def ts_discarded_seqs(t):
    s = t("orders").select("o_custkey", F.explode(F.sequence(F.col("o_orderkey") % 50, F.col("o_orderkey") % 50 + 9)).alias("s"))
    return s.groupBy("o_custkey").agg(F.count_distinct("s").alias("seqs"))


