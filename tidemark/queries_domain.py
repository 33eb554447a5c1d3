"""The domain's tables as views of the generic ones, and the operators over them: summaries, dashboards, discards, exports.

events play polls (sensor user_id % 3; an error is a failed poll), readings of access points (user_id), alerts and rule findings;
orders play security periods, suppliers notes; customer plays access points, nation plays networks and their policies. Each view is
given twice, as a DataFrame and as SQL.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import decisions as D
from tidemark.functions import scalars as S
from tidemark.operators import coverage, discards, intervals, series, summaries
from tidemark.queries import _events, query

NOW = "2024-01-31 12:00:00"

#: Common table expressions of the views; DuckDB evaluates those that a query uses.
V = r"""
with ev as (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events),
polls as (select event_id as id, user_id % 3 as sensor, ts, event_type <> 'error' as ok, event_type <> 'error' and k >= 20 as capture, event_type <> 'error' and k >= 20 and k < 40 as limited, case when k % 4 > 0 then k % 4 > 1 end as hop_ok from ev),
readings as (select event_id as id, user_id as ap, user_id % 3 as sensor, ts, case when k % 17 > 0 then -30 - k // 2 end as level, k % 17 = 0 as is_floor from ev where event_type <> 'error'),
hourly as (select sensor, ap, date_trunc('hour', ts) as hour, count(*) as n_obs, count(level) as n_valid, count(*) filter (where is_floor) as n_floor, quantile_cont(level, 0.5) as median from readings group by 1, 2, 3),
aps as (select c_custkey as ap, 'net' || c_nationkey as network, c_mktsegment as vendor, c_custkey % 4 = 1 as random, c_nationkey % 7 = 0 as hidden, c_acctbal > 5000 as required,
  case c_mktsegment when 'BUILDING' then 'open' when 'MACHINERY' then 'wep' when 'HOUSEHOLD' then 'psk' when 'FURNITURE' then 'sae' else 'enterprise' end as kind from customer),
levels as (select *, case when kind = 'open' then 'open' when kind = 'wep' then 'legacy' when kind = 'psk' then case when required then 'strong' else 'psk_no_mfp' end else 'strong' end as level from aps),
networks as (select 'net' || n_nationkey as network, case when n_regionkey = 0 then 'managed' else 'friendly' end as kind, case n_nationkey % 4 when 0 then 'enterprise' when 1 then 'psk_or_better' when 2 then 'wpa3' end as expected, n_nationkey % 2 = 0 as require_mfp from nation where n_regionkey < 3),
periods as (select o_custkey as ap, vf as valid_from, lead(vf) over (partition by o_custkey order by vf) as valid_to, level from (
  select o_custkey, timestamp '2024-01-01' + to_hours(cast(o_orderkey % 700 as integer)) as vf, max(case o_orderstatus when 'F' then 'open' when 'P' then 'legacy' else 'strong' end) as level from orders group by 1, 2)),
notes as (select s_suppkey as id, s_suppkey % 3 as sensor, case when s_nationkey < 10 then 'gap' when s_nationkey < 20 then 'coverage' else 'hardware_change' end as kind, s_name as label,
  timestamp '2024-01-01' + to_hours(cast(s_suppkey * 37 % 710 as integer)) as starts_at, case when s_acctbal > 0 then timestamp '2024-01-01' + to_hours(cast(s_suppkey * 37 % 710 as integer)) + to_hours(cast(1 + s_nationkey % 5 as integer)) end as ends_at from supplier),
gaps as (select sensor, lag(ts) over (partition by sensor order by ts, id) as lo, ts as hi from polls),
outages as (select sensor, lo as starts_at, hi as ends_at from gaps where hi - lo > interval 20 minute),
p as (select sensor, date_trunc('hour', ts) as hour, count(*) as polls, count(*) filter (where ok) as polls_ok, count(*) filter (where hop_ok) as hop_ok, count(hop_ok) as hop_known, count(*) filter (where capture) as capture, count(*) filter (where limited) as limited from polls group by 1, 2),
gh as (select sensor, h as hour, sum((epoch_us(least(hi, h + interval 1 hour)) - epoch_us(greatest(lo, h))) / 1e6) as gap_s from (select sensor, lo, hi, unnest(generate_series(date_trunc('hour', lo), hi, interval 1 hour)) as h from gaps where hi - lo > interval 90 second) where h < hi group by 1, 2),
ah as (select sensor, hour, count(*) as active, sum(n_obs)::bigint as obs from hourly group by 1, 2),
nh as (select sensor, hour, count(*) as new from (select sensor, ap, min(hour) as hour from hourly group by 1, 2) group by 1, 2),
lh as (select sensor, date_trunc('hour', ts) as hour, count(*) as alerts from polls where not ok group by 1, 2),
hrs as (select sensor, hour from p union select sensor, hour from gh union select sensor, hour from ah union select sensor, hour from lh),
sensor_hours as (select sensor, hour, coalesce(polls, 0) as polls, coalesce(polls_ok, 0) as polls_ok, coalesce(hop_ok, 0) as hop_ok, coalesce(hop_known, 0) as hop_known, coalesce(capture, 0) as capture, coalesce(limited, 0) as limited, coalesce(gap_s, 0) as gap_s,
  coalesce(active, 0) as active, coalesce(obs, 0) as obs, coalesce(new, 0) as new, coalesce(alerts, 0) as alerts from hrs left join p using (sensor, hour) left join gh using (sensor, hour) left join ah using (sensor, hour) left join nh using (sensor, hour) left join lh using (sensor, hour)),
spans as (select sensor, min(ts) as first_poll, max(ts) as last_poll from polls group by 1),
captured as (select *, case when polls > 0 then greatest((least(epoch_us(hour) + 3600000000, epoch_us(last_poll) + 30000000) - greatest(epoch_us(hour), epoch_us(first_poll))) / 1e6 - gap_s, 0) * capture / polls else 0 end as capture_s from sensor_hours join spans using (sensor)),
windows as (select id as win, sensor, starts_at as started_at, starts_at + interval 8 hour as until, ends_at as ended_at from notes where kind = 'gap'),
batches as (select w.win, p.ts as ts_from, p.ts + interval 5 minute as ts_to from windows w join polls p on p.sensor = w.sensor and p.ts >= w.started_at - interval 30 minute and p.ts < w.started_at + interval 3 hour and p.capture),
excl as (select win, sensor, least(started_at, f) as lo, case when ended_at is null and until > timestamp 'NOW' then null else greatest(coalesce(ended_at, until), l + interval 1 second) end as hi from windows left join (select win, min(ts_from) as f, max(ts_to) as l from batches group by 1) using (win)),
em as (select sensor, lo, coalesce(hi, timestamp '9999-01-01') as hi from excl),
eg as (select *, sum(new) over (partition by sensor order by lo, hi) as g from (select *, case when lo > max(hi) over (partition by sensor order by lo, hi rows between unbounded preceding and 1 preceding) then 1 else 0 end as new from em)),
excluded as (select sensor, min(lo) as lo, nullif(max(hi), timestamp '9999-01-01') as hi from eg group by sensor, g)
""".replace("NOW", NOW)


def at(text: str):
    return F.lit(text).cast("timestamp_ntz")


def polls(t):
    ok = F.col("event_type") != "error"
    k = F.col("k")
    return _events(t).select(F.col("event_id").alias("id"), (F.col("user_id") % 3).alias("sensor"), "ts", ok.alias("ok"), (ok & (k >= 20)).alias("capture"), (ok & (k >= 20) & (k < 40)).alias("limited"), F.when(k % 4 > 0, k % 4 > 1).alias("hop_ok"))


def readings(t):
    e = _events(t).where("event_type <> 'error'")
    level = F.when(F.col("k") % 17 > 0, -30 - F.floor(F.col("k") / 2))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("ap"), (F.col("user_id") % 3).alias("sensor"), "ts", level.alias("level"), (F.col("k") % 17 == 0).alias("is_floor"))


def hourly(t):
    return summaries.hourly_levels(readings(t), ["sensor", "ap"])


def aps(t):
    kind = S.choose(F.col("c_mktsegment"), {"BUILDING": "open", "MACHINERY": "wep", "HOUSEHOLD": "psk", "FURNITURE": "sae"}, "enterprise")
    c = t("customer")
    return c.select(
        F.col("c_custkey").alias("ap"), F.concat(F.lit("net"), F.col("c_nationkey").cast("string")).alias("network"), F.col("c_mktsegment").alias("vendor"), (F.col("c_custkey") % 4 == 1).alias("random"),
        (F.col("c_nationkey") % 7 == 0).alias("hidden"), (F.col("c_acctbal") > 5000).alias("required"), kind.alias("kind"),
    )


def levels(t):
    return aps(t).withColumn("level", S.security_level(F.col("kind"), F.col("required")))


def networks(t):
    n = t("nation").where("n_regionkey < 3")
    expected = S.choose(F.col("n_nationkey") % 4, {0: "enterprise", 1: "psk_or_better", 2: "wpa3"})
    return n.select(F.concat(F.lit("net"), F.col("n_nationkey").cast("string")).alias("network"), F.when(F.col("n_regionkey") == 0, "managed").otherwise("friendly").alias("kind"), expected.alias("expected"), (F.col("n_nationkey") % 2 == 0).alias("require_mfp"))


def _hours(n):
    return F.make_dt_interval(hours=n.cast("int"))


def periods(t):
    o = t("orders").select(F.col("o_custkey").alias("ap"), (at("2024-01-01") + _hours(F.col("o_orderkey") % 700)).alias("valid_from"), S.choose(F.col("o_orderstatus"), {"F": "open", "P": "legacy"}, "strong").alias("level"))
    one = o.groupBy("ap", "valid_from").agg(F.max("level").alias("level"))
    return one.select("ap", "valid_from", F.lead("valid_from").over(Window.partitionBy("ap").orderBy("valid_from")).alias("valid_to"), "level")


def notes(t):
    begin = at("2024-01-01") + _hours(F.col("s_suppkey") * 37 % 710)
    kind = F.when(F.col("s_nationkey") < 10, "gap").when(F.col("s_nationkey") < 20, "coverage").otherwise("hardware_change")
    ends = F.when(F.col("s_acctbal") > 0, begin + _hours(1 + F.col("s_nationkey") % 5))
    return t("supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 3).alias("sensor"), kind.alias("kind"), F.col("s_name").alias("label"), begin.alias("starts_at"), ends.alias("ends_at"))


def outages(t):
    return series.gaps(polls(t), ["sensor"], "ts", "id", 1200).select("sensor", F.col("start_at").alias("starts_at"), F.col("end_at").alias("ends_at"))


def sensor_hours(t):
    return summaries.sensor_hours(polls(t), hourly(t), polls(t).where("not ok"))


def spans(t):
    return polls(t).groupBy("sensor").agg(F.min("ts").alias("first_poll"), F.max("ts").alias("last_poll"))


def captured(t):
    return coverage.hour_capture(sensor_hours(t), spans(t))


def windows(t):
    return notes(t).where("kind = 'gap'").select(F.col("id").alias("window"), "sensor", F.col("starts_at").alias("started_at"), (F.col("starts_at") + F.expr("interval 8 hours")).alias("until"), F.col("ends_at").alias("ended_at"))


def batches(t):
    w = windows(t).select("window", "sensor", (F.col("started_at") - F.expr("interval 30 minutes")).alias("lo"), (F.col("started_at") + F.expr("interval 3 hours")).alias("hi"))
    return intervals.points_inside(polls(t).where("capture"), w, ["sensor"], "ts", "lo", "hi").select("window", F.col("ts").alias("ts_from"), (F.col("ts") + F.expr("interval 5 minutes")).alias("ts_to"))


def discarded(t):
    return discards.excluded_spans(windows(t), batches(t), at(NOW))


def excluded(t):
    return intervals.merged(discarded(t).select("sensor", F.col("excl_from").alias("lo"), F.col("excl_to").alias("hi")), ["sensor"], "lo", "hi").drop("n")


# --- summaries -------------------------------------------------------------------------------------------------------


@query("ts_sensor_hourly", V + "select sensor, hour, polls, polls_ok, hop_ok, hop_known, capture, limited, round(gap_s, 3) as gap_s, active, obs, new, alerts from sensor_hours")
def ts_sensor_hourly(t):
    return sensor_hours(t).withColumn("gap_s", F.round("gap_s", 3))


@query("ts_hardware_period", V + """
, c as (select distinct sensor, starts_at from notes where kind = 'hardware_change')
select sensor, starts_at as hw_from, lead(starts_at) over (partition by sensor order by starts_at) as hw_to from c union all select sensor, null, min(starts_at) from c group by 1""")
def ts_hardware_period(t):
    return summaries.hardware_periods(notes(t))


@query("ts_known_bits", """
with h as (select c_nationkey % 5 as key, c_custkey as ts, c_mktsegment as txt, c_custkey % 3 * 8 as bits from customer), c as (select c_nationkey % 5 as key, case when c_custkey % 11 = 0 then null else c_mktsegment end as txt, c_custkey % 2 * 4 as bits, c_custkey as id from customer)
select c.key, c.txt as text, case when c.bits <> 0 or c.txt = 'Open' then c.bits else (select max_by(h.bits, h.ts) from h where h.key = c.key and h.txt is not distinct from c.txt and h.bits <> 0) end as bits from c""")
def ts_known_bits(t):
    c = t("customer")
    key = (F.col("c_nationkey") % 5).alias("key")
    history = c.select(key, F.col("c_custkey").alias("ts"), F.col("c_mktsegment").alias("text"), (F.col("c_custkey") % 3 * 8).alias("bits"))
    current = c.select(key, F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment")).alias("text"), (F.col("c_custkey") % 2 * 4).alias("bits"))
    return summaries.known_bits(history, current, "key")


_AP_SUMMARY = """
, h as (select ap, sum(n_obs)::bigint as n_obs, sum(n_valid)::bigint as n_valid, sum(n_floor)::bigint as n_floor, quantile_cont(median, 0.5) as typical, count(distinct sensor) as sensors from hourly group by 1),
r as (select ap, min(ts) as first_obs, max(ts) as last_obs from readings group by 1),
ch as (select ap, valid_from, level, lag(level) over (partition by ap order by valid_from) as before from periods),
c as (select ap, count(*) as n_changes, max_by(before || '>' || level, valid_from) as last_change, max(valid_from) as last_change_at from ch where before <> level group by 1),
ap_summary as (select l.*, coalesce(n_obs, 0) as n_obs, coalesce(n_valid, 0) as n_valid, coalesce(n_floor, 0) as n_floor, typical, coalesce(sensors, 0) as sensors, first_obs, last_obs, coalesce(n_changes, 0) as n_changes, last_change, last_change_at
  from levels l left join h using (ap) left join r using (ap) left join c using (ap))
"""


def ap_summary(t):
    return summaries.ap_summary(levels(t), hourly(t), readings(t), periods(t))


@query("ts_ap_summary", V + _AP_SUMMARY + "select * from ap_summary")
def ts_ap_summary(t):
    return ap_summary(t)


@query("ts_sensor_summary", V + """
, g as (select sensor, count(*) as gaps, sum((epoch_us(hi) - epoch_us(lo)) / 1e6) as gap_s, max((epoch_us(hi) - epoch_us(lo)) / 1e6) as longest_s from gaps where hi - lo > interval 20 minute group by 1)
select sensor, count(*) as polls, count(*) filter (where ok) as polls_ok, min(ts) as first_poll, max(ts) as last_poll, max(ts) filter (where capture) as last_capture, coalesce(any_value(g.gaps), 0) as gaps, round(coalesce(any_value(gap_s), 0), 3) as gap_s, round(coalesce(any_value(longest_s), 0), 3) as longest_s,
 (select count(distinct ap) from hourly h where h.sensor = polls.sensor) as aps, (select count(*) from notes n where n.sensor = polls.sensor and ends_at is null) as open_notes from polls left join g using (sensor) group by sensor""")
def ts_sensor_summary(t):
    return summaries.sensor_summary(polls(t), hourly(t), notes(t), 1200).withColumns({"gap_s": F.round("gap_s", 3), "longest_s": F.round("longest_s", 3)})


ACCOUNT_APS = """
select ap, network, hidden, level, class, mobile, n.sensor, last_level from (
 select ap, network, hidden, l.level, case when k.kind = 'managed' then case when ap % 5 = 0 then 'managed' else 'suspicious' end when k.kind is not null then 'friendly' when random then 'ignored' else 'unknown' end as class, coalesce(random, false) or starts_with(lower(vendor), 'mach') as mobile
 from levels l left join networks k using (network)) join (select ap, max_by(sensor, (ts, id)) as sensor, max_by(case when level is null then -999 else level end, (ts, id)) as last_level from readings group by 1) n using (ap)"""


def account_aps(t):
    """The current row of each access point, with network, class and whether it is mobile."""
    c = levels(t).join(networks(t).withColumnRenamed("kind", "net_kind"), "network", "left")
    cls = D.ap_class(F.lit(None).cast("string"), F.col("net_kind"), F.col("ap") % 5 == 0, F.lit(False), F.lit(True), F.col("random"), F.lit(None).cast("double"), True, True, True, -90)
    mobile = D.ap_is_mobile(F.col("random"), F.col("vendor"), F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz"), ("Mach",))
    newest = summaries.newest_of(readings(t).withColumn("last_level", F.coalesce("level", F.lit(-999))), "ap", "ts", "id", ["sensor", "last_level"])
    return c.select("ap", "network", "hidden", "level", cls.alias("class"), mobile.alias("mobile")).join(newest, "ap")


@query("ts_account_aps", V + ACCOUNT_APS)
def ts_account_aps(t):
    return account_aps(t)


# --- coverage --------------------------------------------------------------------------------------------------------

_DAY0 = "timestamp '2024-01-01'"


@query("cov_bucket", V + """select sensor, bucket, round(least(1.0, sum(capture_s) / 21600), 3) as share from (
 select *, (epoch_us(hour) - epoch_us(timestamp '2024-01-03')) // 21600000000 + 1 as bucket from captured where hour >= timestamp '2024-01-03' and hour < timestamp '2024-01-10') group by 1, 2""")
def cov_bucket(t):
    n = F.floor((S.micros("hour") - S.micros(at("2024-01-03"))) / 21_600_000_000) + 1
    inside = (F.col("hour") >= at("2024-01-03")) & (F.col("hour") < at("2024-01-10"))
    return coverage.by_bucket(captured(t), F.when(inside, n), 21600.0)


@query("cov_window_share", V + """
, e as (select sensor, sum(greatest((least(epoch_us(coalesce(hi, timestamp '2024-01-20')), epoch_us(timestamp '2024-01-20')) - greatest(epoch_us(lo), epoch_us(timestamp '2024-01-10'))) / 1e6, 0)) as ex from excluded group by 1),
c as (select sensor, sum(capture_s) filter (where hour >= timestamp '2024-01-10' and hour < timestamp '2024-01-20') as s from captured group by 1)
select sensor, case when 864000 - coalesce(ex, 0) > 0 then round(least(1.0, coalesce(s, 0) / (864000 - coalesce(ex, 0))), 3) end as share from c left join e using (sensor)""")
def cov_window_share(t):
    return coverage.window_share(captured(t), excluded(t), at("2024-01-10"), at("2024-01-20"))


@query("cov_day", V + f"""
, days as (select d::date as day, d as lo, least(d + interval 1 day, timestamp '{NOW}') as hi from (select unnest(generate_series({_DAY0}, timestamp '2024-02-02', interval 1 day)) as d) where d < timestamp '{NOW}'),
lim as (select sensor, starts_at as lo, coalesce(ends_at, timestamp '{NOW}') as hi from notes where kind = 'coverage'),
nt as (select sensor, h as hour, least(3600, sum(greatest((least(epoch_us(hi), epoch_us(h) + 3600000000) - greatest(epoch_us(lo), epoch_us(h))) / 1e6, 0))) as noted from (select *, unnest(generate_series(date_trunc('hour', lo), hi, interval 1 hour)) as h from lim where lo < hi) group by 1, 2),
c as (select sensor, hour::date as day, sum(capture_s) as cap, sum(capture_s * greatest(limited::double / capture, coalesce(noted, 0) / 3600)) as lim from captured left join nt using (sensor, hour) where capture > 0 group by 1, 2),
g as (select sensor, day, lo, hi, first_poll, last_poll + interval 30 second as data_end from spans, days),
x as (select g.*, coalesce(sum(case when e.lo is not null and data_end > greatest(g.lo, first_poll) then greatest((least(epoch_us(coalesce(e.hi, timestamp '{NOW}')), epoch_us(least(g.hi, data_end))) - greatest(epoch_us(e.lo), epoch_us(greatest(g.lo, first_poll)))) / 1e6, 0) end), 0) as ex_data,
  coalesce(sum(case when e.lo is not null and g.hi > greatest(g.lo, first_poll, data_end) then greatest((least(epoch_us(coalesce(e.hi, timestamp '{NOW}')), epoch_us(g.hi)) - greatest(epoch_us(e.lo), epoch_us(greatest(g.lo, first_poll, data_end)))) / 1e6, 0) end), 0) as ex_after
  from g left join excluded e on e.sensor = g.sensor group by all),
y as (select x.*, coalesce(cap, 0) as cap, coalesce(lim, 0) as lim, (epoch_us(hi) - epoch_us(lo)) / 1e6 as total from x left join c using (sensor, day))
select sensor, day, round((cap - lim) / total, 3) as ok, round(lim / total, 3) as limited, round(greatest(greatest((least(epoch_us(hi), epoch_us(data_end)) - greatest(epoch_us(lo), epoch_us(first_poll))) / 1e6, 0) - cap - ex_data, 0) / total, 3) as outage,
 round(greatest((least(epoch_us(hi), epoch_us(first_poll)) - epoch_us(lo)) / 1e6, 0) / total, 3) as not_installed, round(greatest(greatest((epoch_us(hi) - greatest(epoch_us(lo), epoch_us(data_end))) / 1e6, 0) - ex_after, 0) / total, 3) as no_data, round((ex_data + ex_after) / total, 3) as excluded from y""")
def cov_day(t):
    day = F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-02-02").cast("date"))).alias("day")
    days = t("region").limit(1).select(day).select("day", F.col("day").cast("timestamp_ntz").alias("lo"), F.date_add("day", 1).cast("timestamp_ntz").alias("hi"))
    limited = notes(t).where("kind = 'coverage'").select("sensor", F.col("starts_at").alias("lo"), F.col("ends_at").alias("hi"))
    return coverage.by_day(captured(t), spans(t), days, excluded(t), limited, at(NOW))


@query("cov_excluded_widen", V + """
, e as (select * from excluded where hi is not null), b as (select e.*, p.ts as before from e asof left join polls p on p.sensor = e.sensor and e.lo >= p.ts), f as (select b.*, p.ts as after from b asof left join polls p on p.sensor = b.sensor and b.hi < p.ts)
select sensor, case when before >= lo - interval 900 second then before else lo end as lo, case when after <= hi + interval 900 second then after else hi end as hi from f""")
def cov_excluded_widen(t):
    return discards.widened(excluded(t).where("hi is not null"), polls(t), ["sensor"], 900)


@query("ts_discard_intervals", V + "select win as id, sensor, lo as excl_from, hi as excl_to from excl")
def ts_discard_intervals(t):
    return discarded(t).withColumnRenamed("window", "id")


@query("ts_discard_close", V + f"select win as id, sensor, 'discard expired' as action, until as at from windows where ended_at is null and until <= timestamp '{NOW}'")
def ts_discard_close(t):
    return discards.closed(windows(t), at(NOW))[1].withColumnRenamed("window", "id")


@query("st_discard", V + "select sensor, count(*) as stored, count(*) filter (where inside) as discarded from (select p.*, exists (select 1 from excluded e where e.sensor = p.sensor and p.ts >= e.lo and (e.hi is null or p.ts < e.hi)) as inside from polls p) group by 1")
def st_discard(t):
    """How many rows of each sensor come, and how many of them fall into a window and are recorded instead of stored."""
    p, kept = polls(t), intervals.points_outside(polls(t), excluded(t), ["sensor"], "ts", "lo", "hi")
    n = kept.groupBy("sensor").agg(F.count("*").alias("kept"))
    return p.groupBy("sensor").agg(F.count("*").alias("stored")).join(n, "sensor", "left").select("sensor", "stored", (F.col("stored") - F.coalesce("kept", F.lit(0))).alias("discarded"))


# --- events ----------------------------------------------------------------------------------------------------------


def _caused(t, least_s: float):
    """Outages of least_s or more with the labels of the notes that overlap them, in order."""
    o = outages(t).where((S.micros("ends_at") - S.micros("starts_at")) / 1e6 >= least_s)
    n = notes(t).where("kind = 'gap'").select("sensor", "label", F.col("starts_at").alias("n_lo"), F.coalesce("ends_at", F.col("starts_at") + F.expr("interval 1 microsecond")).alias("n_hi"))
    met = intervals.overlapping(o, n, ["sensor"], ("starts_at", "ends_at"), ("n_lo", "n_hi"))
    cause = met.groupBy("sensor", "starts_at").agg(summaries.concatenated(F.col("label"), F.col("n_lo")).alias("cause"))
    return o.join(cause, ["sensor", "starts_at"], "left")


_CAUSED = """, caused as (select o.sensor, o.starts_at, o.ends_at, string_agg(n.label, '; ' order by n.starts_at, n.label) as cause from outages o left join notes n on n.sensor = o.sensor and n.kind = 'gap' and n.starts_at < o.ends_at and coalesce(n.ends_at, n.starts_at + interval 1 microsecond) > o.starts_at group by 1, 2, 3)
"""


@query("ts_outage_events", V + _CAUSED + "select sensor, starts_at, ends_at, 'sensor_outage' as type, case when ends_at - starts_at >= interval 1 hour then 'medium' else 'low' end as severity, (epoch_us(ends_at) - epoch_us(starts_at)) // 1000000 as duration_s, cause from caused where ends_at - starts_at >= interval 30 minute")
def ts_outage_events(t):
    o = _caused(t, 1800)
    s = F.floor((S.micros("ends_at") - S.micros("starts_at")) / 1_000_000)
    return o.select("sensor", "starts_at", "ends_at", F.lit("sensor_outage").alias("type"), F.when(s >= 3600, "medium").otherwise("low").alias("severity"), s.alias("duration_s"), "cause")


@query("ts_dataset_outages", V + _CAUSED + "select sensor, strftime(starts_at, '%Y-%m-%d %H:%M') as starts, round((epoch_us(ends_at) - epoch_us(starts_at)) / 3600000000, 2) as hours, coalesce(cause, 'unknown') as cause from caused")
def ts_dataset_outages(t):
    hours = F.round((S.micros("ends_at") - S.micros("starts_at")) / 3_600_000_000, 2)
    return _caused(t, 0).select("sensor", F.date_format("starts_at", "yyyy-MM-dd HH:mm").alias("starts"), hours.alias("hours"), F.coalesce("cause", F.lit("unknown")).alias("cause"))


@query("ts_rule_events", V + _AP_SUMMARY + """
select ap, first_obs as ts, 'unknown_bssid_managed_ssid' as type, 'high' as severity, network, 'Unknown BSSID broadcasting managed SSID "' || network || '"' as summary from ap_summary join networks using (network) where networks.kind = 'managed' and ap % 5 <> 0 and n_obs > 0""")
def ts_rule_events(t):
    s = ap_summary(t).where("n_obs > 0").join(networks(t).withColumnRenamed("kind", "net_kind"), "network")
    cls = D.ap_class(F.lit(None).cast("string"), F.col("net_kind"), F.col("ap") % 5 == 0, F.lit(False), F.lit(True), F.lit(False), F.lit(None).cast("double"), True, True, False, -90)
    text = F.concat(F.lit('Unknown BSSID broadcasting managed SSID "'), F.col("network"), F.lit('"'))
    return s.where(cls == "suspicious").select("ap", F.col("first_obs").alias("ts"), F.lit("unknown_bssid_managed_ssid").alias("type"), F.lit("high").alias("severity"), "network", text.alias("summary"))


@query("ts_event_context", V + """
, al as (select event_id as id, user_id as ap, user_id % 3 as sensor, ts from ev where event_type = 'error'), chg as (select ap, valid_from as at from periods)
select id, exists (select 1 from outages o where o.sensor = al.sensor and al.ts >= o.starts_at and al.ts < o.ends_at) as in_outage, exists (select 1 from notes n where n.kind = 'coverage' and n.sensor = al.sensor and al.ts >= n.starts_at and (n.ends_at is null or al.ts < n.ends_at)) as in_limited,
 (select count(*) from chg where chg.ap = al.ap and chg.at >= al.ts - interval 1 hour and chg.at <= al.ts + interval 1 hour) as changes_near from al""")
def ts_event_context(t):
    """What surrounds each alert: an outage, limited capture, configuration changes within an hour."""
    al = t("events").where("event_type = 'error'").select(F.col("event_id").alias("id"), F.col("user_id").alias("ap"), (F.col("user_id") % 3).alias("sensor"), "ts")
    in_out = intervals.points_inside(al, outages(t), ["sensor"], "ts", "starts_at", "ends_at").select("id").distinct().withColumn("in_outage", F.lit(True))
    lim = notes(t).where("kind = 'coverage'").select("sensor", "starts_at", "ends_at")
    in_lim = intervals.points_inside(al, lim, ["sensor"], "ts", "starts_at", "ends_at").select("id").distinct().withColumn("in_limited", F.lit(True))
    near = al.select("id", "ap", (F.col("ts") - F.expr("interval 1 hour")).alias("lo"), (F.col("ts") + F.expr("interval 1 hour 1 microsecond")).alias("hi"))
    n = intervals.points_inside(periods(t).select("ap", F.col("valid_from").alias("at")), near, ["ap"], "at", "lo", "hi").groupBy("id").agg(F.count("*").alias("changes_near"))
    out = al.select("id").join(in_out, "id", "left").join(in_lim, "id", "left").join(n, "id", "left")
    return out.na.fill(False, ["in_outage", "in_limited"]).na.fill(0, ["changes_near"])
