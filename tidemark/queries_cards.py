"""The status board, sensors' cards and access points' pages, over the domain's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import stats
from tidemark.plans import cards
from tidemark.plans import networks as N
from tidemark.queries import _events, query
from tidemark.queries_boards import _VERDICT
from tidemark.queries_domain import ACCOUNT_APS, NOW, V, account_aps, at, levels, networks, notes, periods, polls, readings, spans, windows


@query("dash_status", V + _VERDICT + f""", acc as ({ACCOUNT_APS}),
op as (select case when k > 80 then 'high' when k > 40 then 'medium' else 'low' end as severity from ev where event_type = 'error' and event_id % 3 = 0),
cand as (select distinct ap from readings where ts >= (select max(ts) from polls where capture) - interval 24 hour),
b as (select vd.network, vd.reason, vd.ap % 13 = 0 as un from vd join cand using (ap) join acc on acc.ap = vd.ap where vd.net_kind = 'managed' and acc.class in ('managed', 'unknown')),
rs as (select network, arg_min(reason, (-n, reason)) as reason from (select network, reason, count(*) as n from b where not un and reason is not null group by 1, 2) group by 1)
select 'severity' as part, severity as name, count(*) as n, null as failing, null as not_assessed, null as reason from op group by 2
union all select 'open', 'all', count(*), null, null, null from op
union all select 'network', n.network, count(*) filter (where not un), count(*) filter (where not un and b.reason is not null), count(*) filter (where un), any_value(rs.reason) from networks n left join b using (network) left join rs using (network) where n.kind = 'managed' group by n.network""")
def dash_status(t):
    """Open events by severity, and how many access points of each managed network meet its policy."""
    e = _events(t).where("event_type = 'error' and event_id % 3 = 0").select(F.when(F.col("k") > 80, "high").when(F.col("k") > 40, "medium").otherwise("low").alias("severity"))
    latest = polls(t).where("capture").agg((F.max("ts") - F.expr("interval 24 hours")).alias("since"))
    cand = readings(t).join(F.broadcast(latest)).where("ts >= since").select("ap").distinct()
    own = account_aps(t).where(F.col("class").isin("managed", "unknown")).select("ap")
    b = N.verdicts(levels(t), networks(t)).where("net_kind = 'managed'").join(cand, "ap", "left_semi").join(own, "ap", "left_semi").select("network", "reason", (F.col("ap") % 13 == 0).alias("unassessed"))
    return cards.status(e, b, networks(t).where("kind = 'managed'").select("network"))


@query("dash_sensors", V + f"""
, sp as (select sensor, (epoch_us(ts) - epoch_us(lead(ts) over (partition by sensor order by ts desc, id desc))) / 1e6 as s, row_number() over (partition by sensor order by ts desc, id desc) as n from polls),
cad as (select sensor, quantile_disc(s, 0.5) as poll_s from sp where n <= 120 and s is not null group by 1),
al as (select event_id as id, user_id % 3 as sensor, ts as t, event_type = 'signup' as o from events where event_type in ('signup', 'error')),
ru as (select *, coalesce(sum(case when o then 1 else 0 end) over (partition by sensor order by t, id rows between unbounded preceding and 1 preceding), 0) as r from al),
re as (select sensor, max(t) filter (where o) as t, min(t) filter (where not o) as f from ru group by sensor, r having max(t) filter (where o) is not null),
cr as (select sensor, count(f) as crashes, count(*) filter (where f is null) as restarts, count(*) filter (where epoch_us(t) - epoch_us(f) <= 60000000) as within_60s, max((epoch_us(t) - epoch_us(f)) // 1000000) as max_recovery_s from re join spans using (sensor) where t > last_poll - interval 24 hour and t <= last_poll group by 1),
la as (select sensor, ap, max(ts) as last from readings group by 1, 2),
hr as (select la.sensor, count(*) as aps_7d, count(*) filter (where not exists (select 1 from la o where o.ap = la.ap and o.sensor <> la.sensor and o.last >= last_poll - interval 7 day)) as only_here_7d from la join spans using (sensor) where last >= last_poll - interval 7 day group by 1),
up as (select user_id % 3 as sensor, max_by(k, (ts, event_id)) as bytes, max(ts) as upload_at from ev where event_type = 'purchase' group by 1),
co as (select o_custkey % 3 as sensor, o_orderkey as version, o_orderstatus = 'F' as confirmed, o_orderstatus = 'P' as refused from orders), cv as (select sensor, max(version) filter (where confirmed) as config_version from co group by 1),
pe as (select sensor, max(version) as pending_version, max_by(refused, version) as refused from co join cv using (sensor) where not confirmed and version > coalesce(config_version, 0) group by 1),
hw as (select sensor, max(starts_at) as last_hardware_change from notes where kind = 'hardware_change' group by 1), di as (select sensor, count(*) as discarding from windows where ended_at is null and until > timestamp '{NOW}' group by 1)
select sensor, first_poll, last_poll, poll_s, coalesce(crashes, 0) as crashes, coalesce(restarts, 0) as restarts, coalesce(within_60s, 0) as within_60s, max_recovery_s, case when last_poll < timestamp '{NOW}' - interval 20 minute then last_poll end as outage_since, coalesce(aps_7d, 0) as aps_7d, coalesce(only_here_7d, 0) as only_here_7d, upload_at, bytes,
 config_version, pending_version, refused, last_hardware_change, coalesce(discarding, 0) as discarding
from spans left join cad using (sensor) left join cr using (sensor) left join hr using (sensor) left join up using (sensor) left join cv using (sensor) left join pe using (sensor) left join hw using (sensor) left join di using (sensor)""")
def dash_sensors(t):
    """A sensor's card: polls, crashes and recoveries, what it hears, its last upload, its configuration and what is pending."""
    sensor = (F.col("user_id") % 3).alias("sensor")
    alerts = t("events").where("event_type in ('signup', 'error')").select(F.col("event_id").alias("id"), sensor, F.col("ts").alias("at"), (F.col("event_type") == "signup").alias("is_open"))
    last = spans(t).select("sensor", "last_poll")
    upload = _events(t).where("event_type = 'purchase'").groupBy(sensor).agg(F.max_by("k", F.struct("ts", "event_id")).alias("bytes"), F.max("ts").alias("upload_at"))
    configs = t("orders").select((F.col("o_custkey") % 3).alias("sensor"), F.col("o_orderkey").alias("version"), (F.col("o_orderstatus") == "F").alias("confirmed"), (F.col("o_orderstatus") == "P").alias("refused"))
    hardware = notes(t).where("kind = 'hardware_change'").groupBy("sensor").agg(F.max("starts_at").alias("last_hardware_change"))
    discarding = windows(t).where(F.col("ended_at").isNull() & (F.col("until") > at(NOW))).groupBy("sensor").agg(F.count("*").alias("discarding"))
    out = spans(t)
    for part in (cards.cadence(polls(t)), cards.crashes(alerts, last), cards.heard(readings(t), last), upload, cards.configurations(configs), hardware, discarding):
        out = out.join(F.broadcast(part), "sensor", "left")  # a row a sensor each
    out = out.withColumn("outage_since", F.when(F.col("last_poll") < at(NOW) - F.expr("interval 20 minutes"), F.col("last_poll")))
    return out.na.fill(0, ["crashes", "restarts", "within_60s", "aps_7d", "only_here_7d", "discarding"])


@query("dash_ap_detail", V + f"""
, sx as (select ap, sensor, count(*) filter (where ts >= timestamp '{NOW}' - interval 7 day) as obs_7d, count(distinct ts::date) as days_seen, quantile_cont(level, 0.5) as median, count(*) filter (where is_floor) as floors, max(ts) as last_seen from readings group by 1, 2),
ch as (select *, lag(level) over (partition by ap order by valid_from) as b from periods), hx as (select ap, valid_from as t, b || ' -> ' || level as text, row_number() over (partition by ap order by valid_from desc) as n from ch where b <> level),
ex as (select user_id as ap, ts as t, case when k > 80 then 'high' when k > 40 then 'medium' else 'low' end || ' #' || event_id as text, row_number() over (partition by user_id order by ts desc, event_id desc) as n from ev where event_type = 'error')
select ap, 'sensor' as part, last_seen as at, sensor || ': ' || obs_7d || ' in 7 d, ' || days_seen || ' days, median ' || coalesce(cast(cast(round(median * 10) as bigint) as varchar), '-') || ', floors ' || floors as text from sx
union all select ap, 'change', t, text from hx where n <= 200 union all select ap, 'event', t, text from ex where n <= 100""")
def dash_ap_detail(t):
    """The page of each access point: what its sensors hear, its configuration changes and its events, newest first."""
    week = F.count_if(F.col("ts") >= at(NOW) - F.expr("interval 7 days")).alias("obs_7d")
    s = readings(t).groupBy("ap", "sensor").agg(week, F.count_distinct(F.to_date("ts")).alias("days"), stats.quantile("level", 0.5).alias("median"), F.count_if("is_floor").alias("floors"), F.max("ts").alias("at"))
    median = F.coalesce(F.round(F.col("median") * 10).cast("long").cast("string"), F.lit("-"))
    text = F.concat(F.col("sensor").cast("string"), F.lit(": "), F.col("obs_7d").cast("string"), F.lit(" in 7 d, "), F.col("days").cast("string"), F.lit(" days, median "), median, F.lit(", floors "), F.col("floors").cast("string"))
    before = F.lag("level").over(Window.partitionBy("ap").orderBy("valid_from"))
    h = periods(t).withColumn("b", before).where("b <> level").select("ap", F.col("valid_from").alias("at"), F.concat_ws(" -> ", "b", "level").alias("text"))
    severity = F.when(F.col("k") > 80, "high").when(F.col("k") > 40, "medium").otherwise("low")
    e = _events(t).where("event_type = 'error'").select(F.col("user_id").alias("ap"), F.col("event_id").alias("id"), F.col("ts").alias("at"), F.concat(severity, F.lit(" #"), F.col("event_id").cast("string")).alias("text"))
    return cards.ap_page(s.select("ap", "at", text.alias("text")), h, e)
