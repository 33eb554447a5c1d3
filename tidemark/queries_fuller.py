"""Composite operators in full: clocks, crashes, attribution, assessments, compliance, heat maps, alarms, calendars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import decisions as D
from tidemark.functions import scalars as S
from tidemark.operators import audit, detect, intervals
from tidemark.plans import dashboards
from tidemark.plans import networks as N
from tidemark.queries import _EV, _events, query
from tidemark.queries_boards import _FROM, _IN, _TO, _VERDICT, _within
from tidemark.queries_domain import NOW, V, at, levels, networks, polls, sensor_hours


@query("upsert_replay_count", "select user_id, event_type, min(ts) as first_at, count(*) - 1 as replays, count(*) > 1 as replayed from events group by 1, 2")
def upsert_replay_count(t):
    from tidemark.operators.merge import replays

    r = replays(t("events"), ["user_id", "event_type"], "ts")
    return r.withColumn("replayed", F.col("replays") > 0)


@query("ts_clock_place", f"""
with b as (select k % 20 as boot, min(epoch_us(ts) // 1000000) as epoch_true, min(epoch_us(ts) // 1000000) - (k % 20) * 3 as epoch_stale, case when k % 20 < 15 then 900000 end as step_mono from {_EV} group by 1, (k % 20) * 3, case when k % 20 < 15 then 900000 end)
select event_id, case when event_type = 'view' or k % 20 < 10 then 'SEND' when user_id % 2 = 0 then 'HOLD' else 'UNVERIFIED' end as fate,
 case when epoch_true - epoch_stale >= 10 and (step_mono is null or f < epoch_stale + step_mono) then f + (epoch_true - epoch_stale) else f end as frame from (select *, epoch_us(ts) // 1000000 as f from {_EV}) e join b on b.boot = e.k % 20""")
def ts_clock_place(t):
    """The fate of each poll, and its frame time shifted by the boot's clock error where it was stale by ten seconds or more."""
    e = _events(t).withColumns({"boot": F.col("k") % 20, "f": F.floor(S.micros("ts") / 1_000_000)})
    b = e.groupBy("boot").agg(F.min("f").alias("epoch_true")).withColumn("epoch_stale", F.col("epoch_true") - F.col("boot") * 3).withColumn("step_mono", F.when(F.col("boot") < 15, 900000))
    x = e.join(F.broadcast(b), "boot")
    fate = D.poll_fate(F.col("event_type") == "view", F.col("boot") < 10, F.col("user_id") % 2 == 0)
    return x.select("event_id", fate.alias("fate"), D.placed_frame(F.col("f"), F.col("epoch_true"), F.col("epoch_stale"), F.col("step_mono")).alias("frame"))


@query("ts_stale_windows", f"""
with w as (select user_id % 3 as sensor, k % 20 as boot, min(ts) as lo, max(ts) as hi from {_EV} where event_type = 'error' group by 1, 2 having max(ts) - min(ts) < interval 9 day), r as (select user_id % 3 as sensor, ts as lo, ts + interval 2 hour as hi from events where event_type = 'signup' and value > 60),
u as (select sensor, lo, hi from w union all select * from r), m as (select *, max(hi) over (partition by sensor order by lo, hi rows between unbounded preceding and 1 preceding) as reach from u), g as (select *, sum(case when lo > reach then 1 else 0 end) over (partition by sensor order by lo, hi) as g from m)
select sensor, min(lo) as lo, max(hi) as hi, count(*) as n from g group by sensor, g""")
def ts_stale_windows(t):
    """Each boot's stale window and the remembered ones, as disjoint windows."""
    e = _events(t).where("event_type = 'error'")
    own = e.groupBy((F.col("user_id") % 3).alias("sensor"), (F.col("k") % 20).alias("boot")).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).where(F.col("hi") < F.col("lo") + F.expr("interval 9 days")).drop("boot")
    kept = t("events").where("event_type = 'signup' and value > 60").select((F.col("user_id") % 3).alias("sensor"), F.col("ts").alias("lo"), (F.col("ts") + F.expr("interval 2 hours")).alias("hi"))
    return intervals.merged(own.union(kept), ["sensor"], "lo", "hi")


@query("ts_crash_recovery", """
with o as (select user_id, ts, event_id, lag(ts) over (partition by user_id order by ts, event_id) as before from events where event_type = 'signup'),
f as (select o.user_id, o.event_id, o.ts, min(e.ts) as first from o left join events e on e.user_id = o.user_id and e.event_type = 'error' and e.ts <= o.ts and (o.before is null or e.ts > o.before) group by 1, 2, 3)
select user_id, count(first) as crashes, count(*) - count(first) as restarts, count(*) filter (where epoch_us(ts) - epoch_us(first) <= 86400000000) as within_day, max((epoch_us(ts) - epoch_us(first)) // 1000000) as max_recovery_s from f group by 1""")
def ts_crash_recovery(t):
    """Re-openings after an error since the one before are crashes, others restarts; recovery counts from the first such error."""
    e = t("events").where("event_type in ('signup', 'error')").withColumn("open", F.col("event_type") == "signup")
    w = Window.partitionBy("user_id").orderBy("ts", "open", "event_id")
    run = e.withColumn("g", F.coalesce(F.sum(F.col("open").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    g = run.groupBy("user_id", "g").agg(F.max(F.when(F.col("open"), F.col("ts"))).alias("at"), F.min(F.when(~F.col("open"), F.col("ts"))).alias("first")).where("at is not null")
    s = S.micros("at") - S.micros("first")
    return g.groupBy("user_id").agg(F.count("first").alias("crashes"), F.count_if(F.col("first").isNull()).alias("restarts"), F.count_if(s <= 86_400_000_000).alias("within_day"), F.max(F.floor(s / 1_000_000)).alias("max_recovery_s"))


@query("ts_churn_daily", V + """
, x as (select ap, min(ts::date) as f, max(ts::date) as l, case when count(distinct date_trunc('hour', ts)) <= 5 then 'transient' else 'sustained' end as class from readings group by 1),
a as (select class, ts::date as day, count(distinct ap) as active from readings join x using (ap) group by 1, 2), n as (select class, f as day, count(*) as new from x group by 1, 2), g as (select class, l as day, count(*) as gone from x group by 1, 2)
select class, day, coalesce(active, 0) as active, coalesce(new, 0) as new, coalesce(gone, 0) as gone from a full join n using (class, day) full join g using (class, day)""")
def ts_churn_daily(t):
    from tidemark.queries_domain import readings

    r = readings(t).select("ap", F.to_date("ts").alias("day"), F.date_trunc("hour", "ts").alias("hour"))
    x = r.groupBy("ap").agg(F.min("day").alias("f"), F.max("day").alias("l"), F.when(F.count_distinct("hour") <= 5, "transient").otherwise("sustained").alias("class"))
    active = r.join(x.select("ap", "class"), "ap").groupBy("class", "day").agg(F.count_distinct("ap").alias("active"))
    by = lambda c, name: x.groupBy("class", F.col(c).alias("day")).agg(F.count("*").alias(name))
    return active.join(by("f", "new"), ["class", "day"], "full").join(by("l", "gone"), ["class", "day"], "full").na.fill(0)


@query("ts_growth", "select event_type, count(*) as rows, count(distinct ts::date) as days, round(count(*)::double / count(distinct ts::date), 6) as per_day, round(count(*)::double / count(distinct ts::date) * 14, 6) as steady from events group by 1")
def ts_growth(t):
    g = t("events").groupBy("event_type").agg(F.count("*").alias("rows"), F.count_distinct(F.to_date("ts")).alias("days"))
    per = F.col("rows") / F.col("days")
    return g.withColumns({"per_day": F.round(per, 6), "steady": F.round(per * 14, 6)})


@query("ts_load_attribution", f"""
with g as (select *, count(case when event_type = 'signup' then 1 end) over (partition by user_id order by ts, event_id rows between current row and unbounded following) as grp from {_EV}), p as (select *, max(case when event_type = 'signup' then k % 13 + 1 end) over (partition by user_id, grp) as channel from g)
select user_id as ap, date_trunc('hour', ts) as hour, coalesce(channel, 0) as channel, count(*) as polls, sum(value) as util, max(k) as clients from p where event_type <> 'signup' group by 1, 2, 3""")
def ts_load_attribution(t):
    """Load by access point, hour and channel, the channel being that of the next report of the point."""
    mark = F.when(F.col("event_type") == "signup", F.col("k") % 13 + 1)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(0, Window.unboundedFollowing)
    p = _events(t).withColumn("channel", F.coalesce(F.first(mark, ignorenulls=True).over(w), F.lit(0)))
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    return p.where("event_type <> 'signup'").groupBy(F.col("user_id").alias("ap"), hour, "channel").agg(F.count("*").alias("polls"), F.sum("value").alias("util"), F.max("k").alias("clients"))


@query("agg_histogram_5db", V + "select ts::date as day, level // 5 * 5 as bin, count(*) as n, min(level) as low, max(level) as high, round(avg(level), 6) as mean, round(stddev_pop(level), 6) as sd from (select ts, level + 1000 as level from readings where level is not null) group by 1, 2")
def agg_histogram_5db(t):
    from tidemark.queries_domain import readings

    r = readings(t).where("level is not null").select(F.to_date("ts").alias("day"), (F.col("level") + 1000).alias("level"))
    g = r.groupBy("day", (F.floor(F.col("level") / 5) * 5).alias("bin"))
    return g.agg(F.count("*").alias("n"), F.min("level").alias("low"), F.max("level").alias("high"), F.round(F.avg("level"), 6).alias("mean"), F.round(F.stddev_pop("level"), 6).alias("sd"))


_WILSON = "round(greatest(0, (p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 9) as low, round(least(1, (p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 9) as high"


@query("agg_recall_cells", f"select event_type, locked, n, hits, round(m, 6) as median_s, round(q, 6) as p95_s, round(p, 9) as recall, {_WILSON} from (select event_type, user_id % 2 = 0 as locked, count(*) as n, count(*) filter (where k > 40) as hits, count(*) filter (where k > 40)::double / count(*) as p, quantile_cont(value, 0.5) filter (where k > 40) as m, quantile_cont(value, 0.95) filter (where k > 40) as q from {_EV} group by 1, 2)")
def agg_recall_cells(t):
    x = _events(t).select("event_type", (F.col("user_id") % 2 == 0).alias("locked"), (F.col("k") > 40).alias("hit"), F.col("value").alias("latency_s"))
    r = audit.recall(x, ["event_type", "locked"])
    return r.withColumns({c: F.round(c, d) for c, d in (("median_s", 6), ("p95_s", 6), ("recall", 9), ("low", 9), ("high", 9))})


@query("agg_rate_table", f"select event_type, n, fp, traced, round(p, 9) as rate, round(traced::double / nullif(fp, 0), 9) as traced_share, {_WILSON} from (select event_type, count(*) as n, count(*) filter (where k < 25) as fp, count(*) filter (where k < 25 and k % 2 = 0) as traced, count(*) filter (where k < 25)::double / count(*) as p from {_EV} group by 1)")
def agg_rate_table(t):
    fp = F.col("k") < 25
    g = _events(t).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(fp).alias("fp"), F.count_if(fp & (F.col("k") % 2 == 0)).alias("traced"))
    low, high = S.wilson(F.col("fp"), F.col("n"))
    return g.withColumns({"rate": F.round(F.col("fp") / F.col("n"), 9), "traced_share": F.round(F.try_divide("traced", "fp"), 9), "low": F.round(low, 9), "high": F.round(high, 9)})


@query("det_deauth_assess", f"""
with f as (select *, case when epoch_us(ts) - epoch_us(lag(ts) over w) > 43200000000 then 1 else 0 end as n, event_type = 'error' as al from {_EV} window w as (partition by user_id order by ts, event_id)),
e as (select *, sum(n) over (partition by user_id order by ts, event_id rows unbounded preceding) as episode from f),
c as (select *, count(*) filter (where not al) over (partition by user_id, episode order by epoch_us(ts) range between 86400000000 preceding and current row) as m from e),
a as (select user_id, episode, count(*) filter (where al) as alerts, count(*) filter (where not al) as bursts, max(m) as most, coalesce((epoch_us(max(ts) filter (where al)) - epoch_us(min(ts) filter (where al))) / 1e6, 0) as span, bool_or(al and k % 5 = 0) as attack from c group by 1, 2),
r as (select user_id, count(*) / 720.0 * 24 as mean from {_EV} where event_type <> 'error' group by 1), x as (select distinct mean, unnest(range(0, 200)) as x from r), s as (select mean, x, sum(exp(-mean + x * ln(mean) - lgamma(x + 1))) over (partition by mean order by x) as cdf from x), th as (select mean, greatest(3, min(x) filter (where cdf > 0.999) + 1) as threshold from s group by 1),
b as (select a.*, coalesce(threshold, 3) as threshold, alerts > 0 as ra, most >= coalesce(threshold, 3) as rb, attack and a.user_id % 5 = 0 as worse from a left join r using (user_id) left join th using (mean)),
l as (select *, case when ra and rb then 3 when ra and span >= 10 then 3 when ra and span >= 2 then 2 when ra then 1 when rb then 2 end as lv from b)
select user_id, cast(episode as bigint) as episode, alerts, bursts, most as most_in_window, threshold, ra as rule_a, rb as rule_b, case (case when lv is null then null else least(lv + case when worse then 1 else 0 end, 4) end) when 1 then 'low' when 2 then 'medium' when 3 then 'high' when 4 then 'critical' end as severity from l""")
def det_deauth_assess(t):
    """Episodes against thresholds from each entity's own rate; a step up where frames look like an attack on a trusted point."""
    rules = detect.BurstRules(gap_s=43200, window_s=86400)
    e = _events(t)
    rates = e.where("event_type <> 'error'").groupBy("user_id").agg((F.count("*") / 720.0).alias("per_hour"))
    alert = F.col("event_type") == "error"
    out = detect.assessed_episodes(e, "user_id", "ts", "event_id", alert, rates, rules, worse=alert & (F.col("k") % 5 == 0), trusted=F.col("user_id") % 5 == 0)
    return out.select("user_id", "episode", "alerts", "bursts", "most_in_window", "threshold", "rule_a", "rule_b", "severity")


@query("det_eval_strays", """
with tr as (select o_custkey as user_id, timestamp '2024-01-01' + to_hours(cast(o_orderkey % 700 as integer)) as start_at from orders)
select event_id from events e where event_type = 'error' and not exists (select 1 from tr where tr.user_id = e.user_id and e.ts >= start_at - interval 300 second and e.ts <= start_at + interval 12 hour + interval 300 second)""")
def det_eval_strays(t):
    """Detections outside the guard band of every trial of their subject: the false positives of an evaluation."""
    start = at("2024-01-01") + F.make_dt_interval(hours=(F.col("o_orderkey") % 700).cast("int"))
    tr = t("orders").select(F.col("o_custkey").alias("user_id"), (start - F.expr("interval 300 seconds")).alias("lo"), (start + F.expr("interval 12 hours 300 seconds 1 microsecond")).alias("hi"))
    return intervals.points_outside(t("events").where("event_type = 'error'"), tr, ["user_id"], "ts", "lo", "hi").select("event_id")


@query("fn_grade_a", f"select event_id, case least(case when k % 2 = 0 and k % 3 = 0 then 1 else 2 end + case when value > 50 then 1 else 0 end + case when user_id % 2 = 0 then 1 else 0 end, 4) when 1 then 'low' when 2 then 'medium' when 3 then 'high' else 'critical' end as severity from {_EV}")
def fn_grade_a(t):
    return _events(t).select("event_id", D.grade_unknown(F.col("k") % 2 == 0, F.col("k") % 3 == 0, F.col("value") > 50, F.col("user_id") % 2 == 0).alias("severity"))


@query("fn_grade_b", f"select event_id, case least(case when value >= 60 then 3 when value >= 30 then 2 else 1 end + case when k % 2 = 0 and k % 3 = 0 then 1 else 0 end + case when user_id % 2 = 0 then 1 else 0 end, 4) when 1 then 'low' when 2 then 'medium' when 3 then 'high' else 'critical' end as severity from {_EV}")
def fn_grade_b(t):
    return _events(t).select("event_id", D.grade_shift(F.col("value"), F.col("k") % 2 == 0, F.col("k") % 3 == 0, F.col("user_id") % 2 == 0, 60, 30).alias("severity"))


@query("fn_clients_source", f"select event_id, case when coalesce(st, 0) > 0 or coalesce(ut, 0) > 0 then 'ap' when cn is not null then 'sensor' end as source from (select event_id, case when k % 3 = 0 then k % 4 end as st, case when k % 5 = 0 then k % 2 end as ut, case when k % 7 > 2 then k end as cn from {_EV})")
def fn_clients_source(t):
    k = F.col("k")
    return _events(t).select("event_id", D.clients_source(F.when(k % 3 == 0, k % 4), F.when(k % 5 == 0, k % 2), F.when(k % 7 > 2, k)).alias("source"))


@query("dash_attention", "with e as (select event_id, ts, cast(floor(value) as bigint) as rank, event_type = 'error' and ts >= timestamp '2024-01-29' as ongoing from events), s as (select * from e where ongoing or (rank >= 30 and ts >= timestamp '2024-01-24')) select event_id, ongoing, rank, (select count(*) from s) as total, (select count(*) from e where rank >= 30 and not ongoing and ts < timestamp '2024-01-24') as older from s order by ongoing desc, rank desc, ts desc, event_id desc limit 20")
def dash_attention(t):
    """What asks for attention: ongoing events first, then recent severe ones, twenty of them, with their number and that of the older ones."""
    e = t("events").withColumns({"rank": F.floor("value"), "ongoing": (F.col("event_type") == "error") & (F.col("ts") >= at("2024-01-29"))})
    recent = F.col("ongoing") | ((F.col("rank") >= 30) & (F.col("ts") >= at("2024-01-24")))
    n = e.agg(F.count_if(recent).alias("total"), F.count_if((F.col("rank") >= 30) & ~F.col("ongoing") & (F.col("ts") < at("2024-01-24"))).alias("older"))
    top = e.where(recent).orderBy(F.desc("ongoing"), F.desc("rank"), F.desc("ts"), F.desc("event_id")).limit(20)
    return top.join(F.broadcast(n)).select("event_id", "ongoing", "rank", "total", "older")


@query("dash_compliance", V + _VERDICT + "select network, reason, count(*) as aps, min(ap) as example from vd where net_kind = 'managed' and reason is not null group by 1, 2")
def dash_compliance(t):
    v = N.verdicts(levels(t), networks(t)).where("net_kind = 'managed' and reason is not null")
    return v.groupBy("network", "reason").agg(F.count("*").alias("aps"), F.min("ap").alias("example"))


_CLIENTS = ", lh0 as (select date_trunc('hour', ts) as hour, max(k) as value from ev where event_type = 'view' group by 1), ch0 as (select hour from sensor_hours group by 1 having sum(capture) > 0)"


def _load_hours(t):
    return _events(t).where("event_type = 'view'").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.max("k").alias("value"))


def _captured_hours(t):
    return sensor_hours(t).groupBy("hour").agg(F.sum("capture").alias("n")).where("n > 0").select("hour")


@query("dash_clients_hourly", V + _CLIENTS + f" select hour, value as clients, value is null as load_missing from ch0 left join lh0 using (hour) where {_IN}")
def dash_clients_hourly(t):
    x = _within(_captured_hours(t)).join(_load_hours(t), "hour", "left")
    return x.select("hour", F.col("value").alias("clients"), F.col("value").isNull().alias("load_missing"))


@query("dash_heatmap", V + _CLIENTS + f"""
, hs as (select unnest(generate_series(timestamp '{_FROM}', timestamp '{_TO}' - interval 1 hour, interval 1 hour)) as hour), c as (select (hour + interval 1 hour)::date as day, hour(hour + interval 1 hour)::int as h, case when ch0.hour is null then 'no_data' when value is null then 'load_missing' else 'ok' end as state, case when ch0.hour is not null then value end as value from hs left join ch0 using (hour) left join lh0 using (hour)),
g as (select distinct day, h::int as h from (select distinct day from c), range(24) r(h))
select day, h as hour, coalesce(state, 'outside') as state, value from g left join c using (day, h)""".replace("when ch0.hour is null then 'no_data'", "when cap is null then 'no_data'").replace("case when ch0.hour is not null then value end", "case when cap is not null then value end").replace("left join ch0 using (hour)", "left join (select hour, 1 as cap from ch0) using (hour)"))
def dash_heatmap(t):
    hours = t("region").limit(1).select(F.explode(F.sequence(at(_FROM), at(_TO) - F.expr("interval 1 hour"), F.expr("interval 1 hour"))).alias("hour"))
    return dashboards.heat_grid(hours, _captured_hours(t), _load_hours(t), "Europe/Bratislava")


_CHANGES = ", cc as (select ap, valid_from, level, lag(level) over (partition by ap order by valid_from) as old from periods)"


@query("dash_security_changes", V + _CHANGES + " select network, date_trunc('minute', valid_from) as minute, old, cc.level as new, count(*) as aps, bool_or(random) as mobile from cc join aps using (ap) where old <> cc.level group by 1, 2, 3, 4")
def dash_security_changes(t):
    from tidemark.queries_domain import aps, periods

    c = periods(t).withColumn("old", F.lag("level").over(Window.partitionBy("ap").orderBy("valid_from"))).where("old <> level").withColumnRenamed("level", "new")
    return c.join(aps(t), "ap").groupBy("network", F.date_trunc("minute", "valid_from").alias("minute"), "old", "new").agg(F.count("*").alias("aps"), F.max("random").alias("mobile"))


_SENSORS = f", st as (select user_id as sensor, (epoch_us(timestamp '{NOW}') - epoch_us(max(ts))) / 1e6 as silent, (epoch_us(timestamp '{NOW}') - epoch_us(max(ts) filter (where event_type = 'view'))) / 1e6 as capture, count(*) filter (where event_type = 'error') % 4 as held, count(*) % 17 as backlog, user_id % 6 = 1 as discarding, max(value) as free from ev group by user_id)"


def _sensor_rows(t):
    since = lambda c: (S.micros(at(NOW)) - F.max(c)) / 1e6
    us = S.micros("ts")
    return t("events").groupBy(F.col("user_id").alias("sensor")).agg(
        since(us).alias("silent_s"), since(F.when(F.col("event_type") == "view", us)).alias("capture_s"), (F.count_if(F.col("event_type") == "error") % 4).alias("held"), (F.count("*") % 17).alias("backlog"), F.max("value").alias("free"),
    ).withColumn("discarding", F.col("sensor") % 6 == 1)


@query("dash_sensor_status", V + _SENSORS + " select sensor, case when silent > 300000 then 'unreachable' when held > 2 then 'clock_unverified' when backlog > 10 then 'catching_up' when discarding then 'discarding' when capture is null or capture > 300000 then 'not_capturing' else 'online' end as status from st")
def dash_sensor_status(t):
    s = _sensor_rows(t)
    return s.select("sensor", dashboards.contact_status(F.col("silent_s"), F.col("capture_s"), F.greatest(F.col("held") - 2, F.lit(0)), F.col("backlog"), F.col("discarding"), 300000, 10).alias("status"))


@query("notify_conditions", V + _SENSORS + " select sensor, 'contact' as alarm from st where silent > 200000 union all select sensor, 'capture' from st where silent <= 200000 and not discarding and (capture is null or capture > 200000) union all select sensor, 'disk' from st where free < 60")
def notify_conditions(t):
    return dashboards.alarms(_sensor_rows(t), 200000, 60.0)


@query("dash_ramp", "select p_partkey, p_retailprice as peak, cast(greatest(floor(ceil(p_retailprice / 10) * 10 * 0.02 / 10 + 0.5) * 10, 10) as double) as t1, cast(floor(ceil(p_retailprice / s) * s * 0.5 / s + 0.5) * s as double) as t3 from (select *, pow(10, greatest(0, floor(log10(p_retailprice)) - 1)) as s from part) where p_retailprice < 1000")
def dash_ramp(t):
    shares = (0.02, 0.2, 0.5)
    r = dashboards.ramp(F.col("p_retailprice"), shares)
    x = t("part").where("p_retailprice < 1000").select("p_partkey", F.col("p_retailprice").alias("peak"), r.alias("r"))
    return x.select("p_partkey", "peak", F.get("r", F.lit(0)).alias("t1"), F.get("r", F.lit(2)).alias("t3"))


@query("an_poll_health", V + "select sensor, count(*) as polls, count(*) filter (where ok) as ok, round(avg(d), 6) as mean_s, max(d) as worst_s, string_agg(distinct err, ',' order by err) as errors from (select p.*, e.value as d, case when not ok then case when e.k > 50 then 'timeout' else 'refused' end end as err from polls p join ev e on e.event_id = p.id) group by 1")
def an_poll_health(t):
    e = _events(t).select(F.col("event_id").alias("id"), F.col("value").alias("d"), "k")
    x = polls(t).join(e, "id").withColumn("err", F.when(~F.col("ok"), F.when(F.col("k") > 50, "timeout").otherwise("refused")))
    errors = F.array_join(F.array_sort(F.collect_set("err")), ",")
    return x.groupBy("sensor").agg(F.count("*").alias("polls"), F.count_if("ok").alias("ok"), F.round(F.avg("d"), 6).alias("mean_s"), F.max("d").alias("worst_s"), F.when(F.count("err") > 0, errors).alias("errors"))


@query("join_nearest_mac", """
with c as (select c_custkey as ap, c_mktsegment as oui, c_custkey * 7919 % 65536 as tail from customer), w as (select *, lag(tail) over (partition by oui order by tail, ap) as b, lag(ap) over (partition by oui order by tail, ap) as ba, lead(tail) over (partition by oui order by tail, ap) as n, lead(ap) over (partition by oui order by tail, ap) as na from c)
select ap, case when b is null or n - tail < tail - b then na else ba end as sibling from w where b is not null or n is not null""")
def join_nearest_mac(t):
    """The access point of the same vendor whose address is nearest: a neighbour in the order of addresses."""
    c = t("customer").select(F.col("c_custkey").alias("ap"), F.col("c_mktsegment").alias("oui"), (F.col("c_custkey") * 7919 % 65536).alias("tail"))
    w = Window.partitionBy("oui").orderBy("tail", "ap")
    x = c.withColumns({f"{n}{k}": f(k).over(w) for n, f in (("before_", F.lag), ("after_", F.lead)) for k in ("tail", "ap")})
    ahead = F.col("before_tail").isNull() | (F.col("after_tail") - F.col("tail") < F.col("tail") - F.col("before_tail"))
    return x.where("before_tail is not null or after_tail is not null").select("ap", F.when(F.coalesce(ahead, F.lit(False)), F.col("after_ap")).otherwise(F.col("before_ap")).alias("sibling"))


@query("cal_days_window", "select (ts + interval 1 hour)::date as day, count(*) as n from events where ts >= timestamp '2024-01-23 23:00:00' and ts < timestamp '2024-01-30 23:00:00' group by 1")
def cal_days_window(t):
    """The last seven local days up to the thirtieth."""
    here = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Europe/Bratislava")
    e = t("events").withColumn("day", F.to_date(here))
    return e.where(F.col("day").between("2024-01-24", "2024-01-30")).groupBy("day").agg(F.count("*").alias("n"))


@query("cal_blocks", "select (ts + interval 1 hour)::date as day, hour(ts + interval 1 hour) // 4 as block, count(*) as n from events group by 1, 2")
def cal_blocks(t):
    """Blocks of four local hours."""
    here = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Europe/Bratislava")
    return t("events").groupBy(F.to_date(here).alias("day"), F.floor(F.hour(here) / 4).alias("block")).agg(F.count("*").alias("n"))


@query("cal_bucket_member", V + f", ch0 as (select hour from sensor_hours group by 1 having sum(capture) > 0) select event_id, (epoch_us(ts) - epoch_us(timestamp '{_FROM}')) // 21600000000 + 1 as bucket, date_trunc('hour', ts) in (select hour from ch0) as captured from ev where ts >= timestamp '{_FROM}' and ts < timestamp '{_TO}'")
def cal_bucket_member(t):
    e = _within(t("events"), "ts").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    x = e.join(_captured_hours(t).withColumn("c", F.lit(True)), "hour", "left")
    n = F.floor((S.micros("ts") - S.micros(at(_FROM))) / 21_600_000_000) + 1
    return x.select("event_id", n.alias("bucket"), F.coalesce("c", F.lit(False)).alias("captured"))


# --- documents in and out --------------------------------------------------------------------------------------------


@query("sink_json_response", "select event_id, '{\"id\":' || event_id || ',\"at\":\"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '\",\"type\":\"' || event_type || '\"}' as body from events")
def sink_json_response(t):
    body = F.to_json(F.struct(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), F.col("event_type").alias("type")))
    return t("events").select("event_id", body.alias("body"))


@query("project_shape_alert", f"select event_id, event_type as header, case when k % 3 > 0 then 'ch' || k % 13 end as channel, case when k % 2 = 0 then 'h' || k else sha1(event_type || '|' || user_id || '|' || case when k % 3 > 0 then 'ch' || k % 13 else '' end) end as hash from {_EV}")
def project_shape_alert(t):
    """Alert documents as rows; an alert without a hash gets one of its fields."""
    ch = F.when(F.col("k") % 3 > 0, F.concat(F.lit("ch"), (F.col("k") % 13).cast("string")))
    own = F.when(F.col("k") % 2 == 0, F.concat(F.lit("h"), F.col("k").cast("string")))
    doc = F.to_json(F.struct(F.col("event_type").alias("header"), F.struct(ch.alias("channel"), F.col("user_id").alias("mac")).alias("base"), own.alias("hash")))
    j = _events(t).select("event_id", doc.alias("d"))
    path = lambda p: F.get_json_object("d", p)
    a = j.select("event_id", path("$.header").alias("header"), path("$.base.channel").alias("channel"), path("$.base.mac").alias("mac"), path("$.hash").alias("own"))
    return a.select("event_id", "header", "channel", F.coalesce("own", S.stable_hash(F.col("header"), F.col("mac"), F.col("channel"))).alias("hash"))


@query("project_shape_device", """
with f as (select l_orderkey, l_linenumber * 5 + 2407 as mhz, sum(l_quantity)::bigint as n from lineitem group by 1, 2)
select l_orderkey as device, arg_max(mhz, (n, -mhz)) as busiest, array_to_string(list(mhz || ':' || n order by mhz), ',') as freqs, sum(n)::bigint as packets from f group by 1""")
def project_shape_device(t):
    """Device documents with a map of packets by frequency, as flat rows."""
    f = t("lineitem").groupBy("l_orderkey", (F.col("l_linenumber") * 5 + 2407).alias("mhz")).agg(F.sum("l_quantity").cast("long").alias("n"))
    doc = f.groupBy("l_orderkey").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(F.col("mhz").cast("string"), "n"))).alias("freq"))).alias("d"))
    pairs = F.transform(F.map_entries(F.from_json("d", "freq map<string, bigint>")["freq"]), lambda e: F.struct(e["key"].cast("long").alias("mhz"), e["value"].alias("n")))
    x = doc.select(F.col("l_orderkey").alias("device"), F.array_sort(pairs).alias("e"))
    best = F.array_max(F.transform("e", lambda e: F.struct(e["n"].alias("n"), (-e["mhz"]).alias("m"))))
    text = F.array_join(F.transform("e", lambda e: F.concat_ws(":", e["mhz"].cast("string"), e["n"].cast("string"))), ",")
    return x.select("device", (-best["m"]).alias("busiest"), text.alias("freqs"), F.aggregate("e", F.lit(0).cast("long"), lambda a, e: a + e["n"]).alias("packets"))


@query("det_evidence_deauth", f"""
with g as (select *, sum(b) over (partition by user_id order by ts, event_id rows unbounded preceding) as g from (select *, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) > 21600000000 then 1 else 0 end as b from {_EV} where event_type = 'error'))
select user_id, g::bigint as episode, '{{"window_start":"' || strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') || '","window_end":"' || strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') || '","alerts":' || count(*) || ',"sources":' || count(distinct k) || ',"ap":{{"id":' || user_id || '}}}}' as evidence from g group by user_id, g""")
def det_evidence_deauth(t):
    """The evidence document of each episode of alerts."""
    from tidemark.operators import series

    e = series.episodes(_events(t).where("event_type = 'error'"), ["user_id"], "ts", "event_id", 21600, F.count_distinct("k").alias("sources"))
    iso = lambda c, name: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(name)
    doc = F.struct(iso("first_at", "window_start"), iso("last_at", "window_end"), F.col("n").alias("alerts"), "sources", F.struct(F.col("user_id").alias("id")).alias("ap"))
    return e.select("user_id", "episode", F.to_json(doc).alias("evidence"))


@query("st_backoff_paging", V + "select sensor, count(*) as rows, max(ts) as upto from (select *, count(*) over (partition by sensor order by date_trunc('hour', ts)) as n from polls) where n <= 200 group by 1")
def st_backoff_paging(t):
    """The first page of each sensor: at most 200 rows, cut between hours, never inside one."""
    h = F.date_trunc("hour", "ts").alias("hour")
    per = polls(t).groupBy("sensor", h).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    upto = F.sum("n").over(Window.partitionBy("sensor").orderBy("hour"))
    page = per.withColumn("upto_n", upto).where("upto_n <= 200")
    return page.groupBy("sensor").agg(F.sum("n").alias("rows"), F.max("last").alias("upto"))
