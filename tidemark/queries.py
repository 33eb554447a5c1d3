"""The operators bound to the generic tables, each with the same result in DuckDB SQL.

events play observations and alerts (entity user_id, reading value), orders play configuration history, orders and lineitem
play intervals, customer and nation play dimensions, labels play operators' labels, documents play free text.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import calendar, changes, intervals, merge, paging, rollup, series, stats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (table reader) as a query."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return add


_EV = "(select *, cast(json_extract_string(props, '$.k') as bigint) as k from events)"


def _events(t):
    return t("events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


# --- scans, filters, projections -------------------------------------------------------------------------------------


@query("scan_table", "select event_id, user_id, value from events where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-20' and event_type = 'error'")
def scan_table(t):
    at = F.col("ts")
    return t("events").where((at >= F.lit("2024-01-10").cast("timestamp_ntz")) & (at < F.lit("2024-01-20").cast("timestamp_ntz")) & (F.col("event_type") == "error")).select("event_id", "user_id", "value")


@query("scan_index_range", "select e.user_id, count(*) as n from events e where e.user_id in (select c_custkey from customer where c_nationkey < 5) and ts >= timestamp '2024-01-15' group by 1")
def scan_index_range(t):
    some = t("customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("user_id"))
    return t("events").where(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")).join(some, "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("n"))


@query("src_generate_series", "select o_orderkey, unnest(range(o_orderkey % 5 + 1)) as i from orders")
def src_generate_series(t):
    return t("orders").select("o_orderkey", F.explode(F.sequence(F.lit(0).cast("long"), F.col("o_orderkey") % 5)).alias("i"))


@query("filter_any_array", "select event_type, count(*) as n from events where event_type in ('click', 'error') group by 1")
def filter_any_array(t):
    return t("events").where(F.col("event_type").isin("click", "error")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("filter_min_severity", "select o_orderkey from orders where list_position(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT'], o_orderpriority) >= 4")
def filter_min_severity(t):
    names = ("5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT")
    return t("orders").where(paging.severity_at_least(F.col("o_orderpriority"), "2-HIGH", names)).select("o_orderkey")


@query("filter_search", "select c_custkey, c_name from customer where contains(lower(c_name), '0_1') or contains(lower(c_name), '#00000001')")
def filter_search(t):
    name = F.lower("c_name")
    return t("customer").where(name.contains("0_1") | name.contains("#00000001")).select("c_custkey", "c_name")


@query("filter_not_exists_interval", """
select l_orderkey, l_linenumber from lineitem l where not exists (
  select 1 from orders o where o.o_custkey = l.l_suppkey and o.o_orderdate <= l.l_shipdate and l.l_shipdate < o.o_orderdate + interval 30 day)""")
def filter_not_exists_interval(t):
    spans = t("orders").select(F.col("o_custkey").alias("l_suppkey"), F.col("o_orderdate").alias("lo"), (F.col("o_orderdate") + F.expr("interval 30 days")).alias("hi"))
    return intervals.points_outside(t("lineitem"), spans, ["l_suppkey"], "l_shipdate", "lo", "hi").select("l_orderkey", "l_linenumber")


@query("project_unpivot", "select p_partkey, field, val from (select p_partkey, p_brand, p_type, p_name from part) unpivot (val for field in (p_brand, p_type, p_name))")
def project_unpivot(t):
    return t("part").unpivot("p_partkey", ["p_brand", "p_type", "p_name"], "field", "val").where("val is not null")


@query("project_json_path", f"select event_id, k, k >= 50 as big from {_EV}")
def project_json_path(t):
    return _events(t).select("event_id", "k", (F.col("k") >= 50).alias("big"))


@query("project_coalesce_chain", "select event_id, coalesce(nullif(event_type, 'view'), case when value > 50 then 'large' end, 'hidden:' || cast(user_id as varchar)) as network from events")
def project_coalesce_chain(t):
    return t("events").select("event_id", F.coalesce(F.nullif("event_type", F.lit("view")), F.when(F.col("value") > 50, "large"), F.concat(F.lit("hidden:"), F.col("user_id").cast("string"))).alias("network"))


@query("validate_rows", """
select event_id, case when value is null then 'value missing' when value < 1 then 'value out of range' when event_type not in ('click', 'view', 'purchase', 'signup', 'error') then 'unknown type'
  when row_number() over (partition by user_id, date_trunc('minute', ts) order by event_id) > 1 then 'duplicate key' end as reject_reason from events""")
def validate_rows(t):
    from pyspark.sql import Window

    again = F.row_number().over(Window.partitionBy("user_id", F.date_trunc("minute", "ts")).orderBy("event_id")) > 1
    kinds = ("click", "view", "purchase", "signup", "error")
    reason = F.when(F.col("value").isNull(), "value missing").when(F.col("value") < 1, "value out of range").when(~F.col("event_type").isin(*kinds), "unknown type").when(again, "duplicate key")
    return t("events").select("event_id", reason.alias("reject_reason"))


@query("label_constraint", """
select doc_id, case when quality = 1 and toxic = 1 then false when quality is null then coalesce(toxic, 0) = 0 else true end as accepted from labels""")
def label_constraint(t):
    ok = F.when((F.col("quality") == 1) & (F.col("toxic") == 1), False).when(F.col("quality").isNull(), F.coalesce("toxic", F.lit(0)) == 0).otherwise(True)
    return t("labels").select("doc_id", ok.alias("accepted"))


# --- joins -----------------------------------------------------------------------------------------------------------


@query("join_inner_equi", "select c_nationkey, count(*) as n, round(sum(o_totalprice), 2) as total from customer join orders on c_custkey = o_custkey group by 1")
def join_inner_equi(t):
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("join_left", "select c_custkey, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey group by 1")
def join_left(t):
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("join_full_hours", """
select coalesce(a.d, b.d) as d, coalesce(a.n, 0) as events, coalesce(b.n, 0) as errors from
 (select date_trunc('day', ts) as d, count(*) as n from events group by 1) a full join
 (select date_trunc('day', ts) as d, count(*) as n from events where event_type = 'error' group by 1) b on a.d = b.d""")
def join_full_hours(t):
    by = lambda e, name: e.groupBy(F.date_trunc("day", "ts").alias("d")).agg(F.count("*").alias(name))
    both = by(t("events"), "events").join(by(t("events").where("event_type = 'error'"), "errors"), "d", "full")
    return both.select("d", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("errors", F.lit(0)).alias("errors"))


@query("join_nullsafe", """
with o as (select o_orderkey, nullif(o_orderstatus, 'P') as s from orders), k as (select distinct s, upper(s) as label from o)
select o.o_orderkey, coalesce(k.label, 'none') as label from o join k on o.s is not distinct from k.s""")
def join_nullsafe(t):
    o = t("orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("s"))
    k = o.select(F.col("s").alias("s2"), F.upper("s").alias("label")).distinct()
    return o.join(k, F.col("s").eqNullSafe(F.col("s2"))).select("o_orderkey", F.coalesce("label", F.lit("none")).alias("label"))


@query("join_semi", "select s_suppkey from supplier where exists (select 1 from lineitem where l_suppkey = s_suppkey and l_quantity > 49)")
def join_semi(t):
    return t("supplier").join(t("lineitem").where("l_quantity > 49"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select("s_suppkey")


@query("join_anti", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def join_anti(t):
    return t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


_SPANS = "(select o_custkey, o_orderkey, o_orderdate as lo, o_orderdate + interval 20 day as hi from orders)"


def _spans(t, suffix=""):
    o = t("orders")
    return o.select("o_custkey", F.col("o_orderkey").alias(f"key{suffix}"), F.col("o_orderdate").alias(f"lo{suffix}"), (F.col("o_orderdate") + F.expr("interval 20 days")).alias(f"hi{suffix}"))


@query("join_interval_overlap", f"""
select a.o_orderkey as a, b.o_orderkey as b, epoch(least(a.hi, b.hi)) - epoch(greatest(a.lo, b.lo)) as seconds
from {_SPANS} a join {_SPANS} b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey and a.lo < b.hi and b.lo < a.hi""")
def join_interval_overlap(t):
    both = intervals.overlapping(_spans(t, "1"), _spans(t, "2"), ["o_custkey"], ("lo1", "hi1"), ("lo2", "hi2")).where("key1 < key2")
    return both.select(F.col("key1").alias("a"), F.col("key2").alias("b"), intervals.overlap_seconds("lo1", "hi1", "lo2", "hi2").alias("seconds"))


@query("join_point_in_interval", f"""
select l_orderkey, l_linenumber, o.o_orderkey as inside from lineitem join {_SPANS} o on o.o_custkey = l_suppkey and l_shipdate >= lo and l_shipdate < hi""")
def join_point_in_interval(t):
    points = t("lineitem").select(F.col("l_suppkey").alias("o_custkey"), "l_orderkey", "l_linenumber", "l_shipdate")
    return intervals.points_inside(points, _spans(t), ["o_custkey"], "l_shipdate", "lo", "hi").select("l_orderkey", "l_linenumber", F.col("key").alias("inside"))


_CHG = "(select user_id, ts, max_by(event_type, event_id) as state from events where event_type <> 'view' group by 1, 2)"


def _states(t):
    e = t("events").where("event_type <> 'view'")
    return e.groupBy("user_id", F.col("ts").alias("changed_at")).agg(F.max_by("event_type", "event_id").alias("state"))


@query("join_asof_backward", f"select e.event_id, c.state from events e asof left join {_CHG} c on e.user_id = c.user_id and e.ts >= c.ts where e.event_type = 'view'")
def join_asof_backward(t):
    views = t("events").where("event_type = 'view'").select("user_id", "event_id", "ts")
    return intervals.asof(views, _states(t), ["user_id"], "ts", "changed_at", ["state"]).select("event_id", "state")


@query("join_asof_forward", f"select e.event_id, c.state from events e asof left join {_CHG} c on e.user_id = c.user_id and e.ts < c.ts where e.event_type = 'view'")
def join_asof_forward(t):
    views = t("events").where("event_type = 'view'").select("user_id", "event_id", "ts")
    return intervals.asof(views, _states(t), ["user_id"], "ts", "changed_at", ["state"], forward=True).select("event_id", "state")


@query("join_lateral_top1", "select c_custkey, o_orderkey, o_totalprice from (select c_custkey, o_orderkey, o_totalprice, row_number() over (partition by c_custkey order by o_orderdate desc, o_orderkey desc) as k from customer join orders on o_custkey = c_custkey) where k = 1")
def join_lateral_top1(t):
    newest = t("orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("x"))
    return t("customer").join(newest, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "x.o_orderkey", "x.o_totalprice")


@query("join_nearest_key", """
select c_custkey, sibling from (select a.c_custkey, b.c_custkey as sibling, row_number() over (partition by a.c_custkey order by abs(a.c_custkey - b.c_custkey), b.c_custkey) as k
 from customer a join customer b on a.c_nationkey = b.c_nationkey and a.c_mktsegment = b.c_mktsegment and a.c_custkey <> b.c_custkey) where k = 1""")
def join_nearest_key(t):
    # the nearest in order is a neighbour
    w = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")
    c = t("customer").withColumns({"before": F.lag("c_custkey").over(w), "after": F.lead("c_custkey").over(w)})
    nearer = F.col("c_custkey") - F.col("before") <= F.col("after") - F.col("c_custkey")
    sibling = F.when(F.coalesce(nearer, F.col("after").isNull()), F.col("before")).otherwise(F.col("after"))
    return c.select("c_custkey", sibling.alias("sibling")).where("sibling is not null")


# --- aggregations ----------------------------------------------------------------------------------------------------


@query("agg_hash", "select user_id, count(*) as n, round(avg(value), 6) as mean, min(value) as low, max(value) as high from events group by 1")
def agg_hash(t):
    return t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("agg_filter", "select user_id, count(*) filter (where event_type = 'error') as errors, count(distinct event_type) filter (where value > 20) as kinds from events group by 1")
def agg_filter(t):
    return t("events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_distinct(F.when(F.col("value") > 20, F.col("event_type"))).alias("kinds"))


@query("agg_having", "select user_id, count(distinct cast(ts as date)) as days from events group by 1 having count(*) >= 60 and count(distinct cast(ts as date)) >= 20")
def agg_having(t):
    return t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct(F.to_date("ts")).alias("days")).where("n >= 60 and days >= 20").select("user_id", "days")


@query("agg_percentile_disc", "select event_type, quantile_disc(value, 0.5) as median from events group by 1")
def agg_percentile_disc(t):
    return t("events").groupBy("event_type").agg(F.expr("percentile_disc(0.5) within group (order by value)").alias("median"))


@query("agg_mode", "select user_id, event_type, n from (select user_id, event_type, count(*) as n, row_number() over (partition by user_id order by count(*) desc, event_type) as k from events group by 1, 2) where k = 1")
def agg_mode(t):
    return stats.mode(t("events"), ["user_id"], "event_type")


@query("agg_mad_robust_sd", """
with m as (select user_id, median(value) as median from events group by 1)
select user_id, round(any_value(m.median), 6) as median, round(1.4826 * median(abs(value - m.median)), 6) as robust_sd from events join m using (user_id) group by 1""")
def agg_mad_robust_sd(t):
    return stats.robust_spread(t("events"), ["user_id"], "value").select("user_id", F.round("median", 6).alias("median"), F.round("robust_sd", 6).alias("robust_sd"))


@query("agg_first_ordered", "select user_id, arg_min(event_type, event_id) as first_type, arg_max(value, event_id) as last_value from events group by 1")
def agg_first_ordered(t):
    return t("events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_type"), F.max_by("value", "event_id").alias("last_value"))


@query("agg_array", "select user_id, array_to_string(list_sort(list(distinct event_type)), ',') as kinds from events group by 1")
def agg_array(t):
    return t("events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("agg_string", "select o_custkey, string_agg(cast(o_orderkey as varchar), ';' order by o_orderdate, o_orderkey) as orders from orders group by 1")
def agg_string(t):
    each = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey")))
    return t("orders").groupBy("o_custkey").agg(F.array_join(F.transform(each, lambda x: x["o_orderkey"].cast("string")), ";").alias("orders"))


@query("agg_bit_or", "select user_id, bit_or(1::bigint << (event_id % 60)::int) as mask from events group by 1")
def agg_bit_or(t):
    return t("events").groupBy("user_id").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("event_id") % 60).cast("int"))).alias("mask"))


@query("agg_grouping_sets", """
select coalesce(o_orderstatus, '*') as status, coalesce(o_orderpriority, '*') as priority, count(*) as n, round(sum(o_totalprice), 2) as total
from orders group by grouping sets ((o_orderstatus, o_orderpriority), (o_orderstatus), (o_orderpriority), ())""")
def agg_grouping_sets(t):
    keys = [[F.col("o_orderstatus"), F.col("o_orderpriority")], [F.col("o_orderstatus")], [F.col("o_orderpriority")], []]
    g = t("orders").groupingSets(keys, "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping("o_orderstatus").alias("gs"), F.grouping("o_orderpriority").alias("gp"))
    star = lambda c, g: F.when(F.col(g) == 1, "*").otherwise(F.col(c))
    return g.select(star("o_orderstatus", "gs").alias("status"), star("o_orderpriority", "gp").alias("priority"), "n", "total")


@query("agg_two_level", "select d, round(avg(m), 6) as mean_of_max, count(*) as entities from (select cast(ts as date) as d, user_id, max(value) as m from events group by 1, 2) group by 1")
def agg_two_level(t):
    per = t("events").groupBy(F.to_date("ts").alias("d"), "user_id").agg(F.max("value").alias("m"))
    return per.groupBy("d").agg(F.round(F.avg("m"), 6).alias("mean_of_max"), F.count("*").alias("entities"))


@query("agg_weighted_mean", "select l_returnflag, round(sum(l_extendedprice) / nullif(sum(l_quantity), 0), 6) as mean from lineitem group by 1")
def agg_weighted_mean(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.round(stats.weighted_mean("l_extendedprice", "l_quantity"), 6).alias("mean"))


@query("agg_histogram", "select cast(floor(value / 5) * 5 as bigint) as bin, count(*) as n from events group by 1")
def agg_histogram(t):
    return t("events").groupBy((F.floor(F.col("value") / 5) * 5).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("agg_wilson", """
with c as (select source, count(*) as n, count(*) filter (where toxic = 1) as k from labels join documents using (doc_id) group by 1),
w as (select *, (k::double / n + 1.96 * 1.96 / (2.0 * n)) as centre, 1.96 * sqrt(k::double / n * (1 - k::double / n) / n + 1.96 * 1.96 / (4.0 * n * n)) as half, 1 + 1.96 * 1.96 / n as denom from c)
select source, k, n, round(greatest(0, (centre - half) / denom), 6) as lo, round(least(1, (centre + half) / denom), 6) as hi from w""")
def agg_wilson(t):
    c = t("labels").join(t("documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("k"))
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    return c.select("source", "k", "n", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query("agg_entropy", "select user_id, round(sum(-p * log2(p)), 6) as bits from (select user_id, count(*)::double / sum(count(*)) over (partition by user_id) as p from events group by user_id, event_type) group by 1")
def agg_entropy(t):
    return stats.entropy(t("events"), ["user_id"], "event_type").select("user_id", F.round("bits", 6).alias("bits"))


@query("agg_pivot", "select l_returnflag, count(*) filter (where l_linestatus = 'F') as f, count(*) filter (where l_linestatus = 'O') as o from lineitem group by 1")
def agg_pivot(t):
    return t("lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).select("l_returnflag", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query("agg_long_metrics", "select unnest(['events', 'users', 'errors']) as metric, unnest([count(*), count(distinct user_id), count(*) filter (where event_type = 'error')]) as val from events")
def agg_long_metrics(t):
    one = t("events").agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return one.unpivot([], ["events", "users", "errors"], "metric", "val")


@query("agg_agreement", "select quality, toxic, count(*) as n, quality <> toxic as agree from labels group by 1, 2")
def agg_agreement(t):
    return t("labels").groupBy("quality", "toxic").agg(F.count("*").alias("n")).withColumn("agree", F.col("quality") != F.col("toxic"))


@query("agg_fixed_order_share", """
select c.kind, coalesce(n, 0) as n, round(coalesce(n, 0)::double / sum(coalesce(n, 0)) over (), 6) as share
from (select unnest(['click', 'view', 'purchase', 'signup', 'error', 'other']) as kind) c left join (select event_type, count(*) as n from events group by 1) e on e.event_type = c.kind""")
def agg_fixed_order_share(t):
    kinds = ("click", "view", "purchase", "signup", "error", "other")
    one = t("events").agg(F.count("*").alias("all"), *(F.count_if(F.col("event_type") == k).alias(k) for k in kinds))
    long = one.unpivot(["all"], list(kinds), "kind", "n")
    shown = F.sum(F.col("n"))
    total = long.agg(shown.alias("total"))
    return long.crossJoin(F.broadcast(total)).select("kind", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


# --- windows and series ----------------------------------------------------------------------------------------------


@query("win_lag_lead", "select event_id, lag(value) over w as before, lead(ts) over w as next_at from events window w as (partition by user_id order by ts, event_id)")
def win_lag_lead(t):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t("events").select("event_id", F.lag("value").over(w).alias("before"), F.lead("ts").over(w).alias("next_at"))


@query("win_frame_preceding_excl", "select event_id, max(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as reach from events")
def win_frame_preceding_excl(t):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return t("events").select("event_id", F.max("value").over(w).alias("reach"))


@query("win_dense_rank", "select distinct event_type, user_id % 7 as g, dense_rank() over (partition by user_id % 7 order by event_type) as id from events")
def win_dense_rank(t):
    from pyspark.sql import Window

    d = t("events").select("event_type", (F.col("user_id") % 7).alias("g")).distinct()
    return d.withColumn("id", F.dense_rank().over(Window.partitionBy("g").orderBy("event_type")))


@query("win_sliding_median_mad", """
with w as (select event_id, list(value) over (partition by user_id order by ts, event_id rows 9 preceding) as l from events),
m as (select event_id, l, list_aggregate(l, 'median') as md from w where len(l) = 10)
select event_id, round(md, 6) as win_median, round(list_aggregate(list_transform(l, lambda x: abs(x - md)), 'median'), 6) as win_mad from m""")
def win_sliding_median_mad(t):
    w = series.sliding_median_mad(t("events"), ["user_id"], ["ts", "event_id"], "value", 10)
    return w.where("win_median is not null").select("event_id", F.round("win_median", 6).alias("win_median"), F.round("win_mad", 6).alias("win_mad"))


@query("win_max_in_span", "select user_id, max(n) as most from (select user_id, count(*) over (partition by user_id order by epoch_us(ts) range between 21600000000 preceding and current row) as n from events) group by 1")
def win_max_in_span(t):
    return series.most_in_span(t("events"), ["user_id"], "ts", 6 * 3600)


@query("win_run_lengths", """
with r as (select user_id, row_number() over (partition by user_id order by ts, event_id) - row_number() over (partition by user_id, value > 30 order by ts, event_id) as g, value > 30 as f from events)
select user_id, length, count(*) as runs from (select user_id, g, count(*) as length from r where f group by 1, 2) group by 1, 2""")
def win_run_lengths(t):
    return series.run_lengths(t("events"), ["user_id"], ["ts", "event_id"], F.col("value") > 30)


@query("win_seq_delta_mod", "select event_id, (((event_id * 37) % 4096 - lag((event_id * 37) % 4096) over (partition by user_id order by ts, event_id)) % 4096 + 4096) % 4096 as step from events")
def win_seq_delta_mod(t):
    e = t("events").withColumn("seq", F.col("event_id") * 37 % 4096)
    return series.counter_steps(e, ["user_id"], ["ts", "event_id"], "seq", 4096).select("event_id", "step")


@query("win_train_test_split", "select event_id, row_number() over (partition by user_id order by ts, event_id) <= floor(count(*) over (partition by user_id) * 0.6) as in_train from events")
def win_train_test_split(t):
    return series.train_test(t("events"), ["user_id"], ["ts", "event_id"], 0.6).select("event_id", "in_train")


@query("win_drift", """
with d as (select user_id, cast(ts as date) as d, avg(value) as m from events group by 1, 2), s as (select *, abs(m - lag(m) over (partition by user_id order by d)) as step from d)
select user_id, count(*) as days, round(max(m) - min(m), 6) as spread, round(max(step), 6) as largest_step, round(stddev_pop(m), 6) as sd from s group by 1""")
def win_drift(t):
    from pyspark.sql import Window

    d = t("events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.avg("value").alias("m"))
    s = d.withColumn("step", F.abs(F.col("m") - F.lag("m").over(Window.partitionBy("user_id").orderBy("d"))))
    r = lambda c, name: F.round(c, 6).alias(name)
    return s.groupBy("user_id").agg(F.count("*").alias("days"), r(F.max("m") - F.min("m"), "spread"), r(F.max("step"), "largest_step"), r(F.stddev_pop("m"), "sd"))


_EPISODES = """
with f as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over w > 43200000000 then 1 else 0 end as n from events window w as (partition by user_id order by ts, event_id)),
e as (select *, sum(n) over (partition by user_id order by ts, event_id rows unbounded preceding) as episode from f)
select user_id, cast(episode as bigint) as episode, min(ts) as first_at, max(ts) as last_at, count(*) as n, max(value) as peak, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) as seconds from e group by 1, 2"""


@query("ts_sessionize", _EPISODES)
def ts_sessionize(t):
    e = series.episodes(t("events"), ["user_id"], "ts", "event_id", 12 * 3600, F.max("value").alias("peak"))
    return e.withColumn("seconds", F.round("seconds", 3))


@query("ts_gaps", """
select user_id, start_at, end_at, round(s, 3) as seconds from (select user_id, lag(ts) over w as start_at, ts as end_at, (epoch_us(ts) - epoch_us(lag(ts) over w)) / 1e6 as s from events window w as (partition by user_id order by ts, event_id)) where s > 86400""")
def ts_gaps(t):
    return series.gaps(t("events"), ["user_id"], "ts", "event_id", 86400).withColumn("seconds", F.round("seconds", 3))


@query("ts_gap_split_hours", """
with g as (select * from (select user_id, lag(ts) over w as a, ts as b from events window w as (partition by user_id order by ts, event_id)) where epoch_us(b) - epoch_us(a) > 86400000000),
h as (select *, unnest(generate_series(date_trunc('hour', a), b, interval 1 hour)) as hour from g)
select user_id, a as start_at, hour, round((least(epoch_us(b), epoch_us(hour) + 3600000000) - greatest(epoch_us(a), epoch_us(hour))) / 1e6, 3) as seconds_in_hour
from h where least(epoch_us(b), epoch_us(hour) + 3600000000) > greatest(epoch_us(a), epoch_us(hour))""")
def ts_gap_split_hours(t):
    g = series.gaps(t("events"), ["user_id"], "ts", "event_id", 86400)
    return series.split_by_hour(g, "start_at", "end_at").select("user_id", "start_at", F.col("hour").cast("timestamp_ntz").alias("hour"), F.round("seconds_in_hour", 3).alias("seconds_in_hour"))


@query("ts_state_periods", """
with n as (select *, lead(ts) over (partition by user_id order by ts, event_id) as nx from events),
s as (select *, case when epoch_us(nx) - epoch_us(ts) > 172800000000 then 'outage' when event_type = 'error' then 'limited' else 'ok' end as state from n),
c as (select *, case when state is distinct from lag(state) over (partition by user_id order by ts, event_id) then 1 else 0 end as ch from s),
r as (select *, sum(ch) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from c)
select user_id, any_value(state) as state, min(ts) as from_at, case when not bool_or(nx is null) then max(nx) end as to_at, count(*) as n from r group by user_id, run""")
def ts_state_periods(t):
    e = t("events").withColumn("poll", F.when(F.col("event_type") == "error", "limited").otherwise("ok"))
    return series.state_periods(e, ["user_id"], "ts", "event_id", "poll", 2 * 86400)


@query("ts_interval_merge", f"""
with r as (select *, max(hi) over (partition by o_custkey order by lo, hi rows between unbounded preceding and 1 preceding) as reach from {_SPANS}),
g as (select *, sum(case when reach is null or lo > reach then 1 else 0 end) over (partition by o_custkey order by lo, hi rows unbounded preceding) as run from r)
select o_custkey, min(lo) as lo, max(hi) as hi, count(*) as n from g group by o_custkey, run""")
def ts_interval_merge(t):
    return intervals.merged(_spans(t), ["o_custkey"], "lo", "hi")


@query("set_ranges", "select o_custkey, min(m) as first, max(m) as last from (select o_custkey, m, m - row_number() over (partition by o_custkey order by m) as g from (select distinct o_custkey, o_orderkey // 50 as m from orders)) group by o_custkey, g")
def set_ranges(t):
    return series.id_ranges(t("orders").withColumn("m", F.expr("o_orderkey div 50")), ["o_custkey"], "m")


@query("ts_interpolate", f"""
with s as (select user_id, ts, max(value) as v from events where event_type <> 'view' group by 1, 2),
q as (select user_id, event_id, ts from events where event_type = 'view'),
b as (select q.*, s.ts as t0, s.v as v0 from q asof left join s on q.user_id = s.user_id and q.ts >= s.ts),
f as (select b.*, s.ts as t1, s.v as v1 from b asof left join s on b.user_id = s.user_id and b.ts <= s.ts)
select event_id, round(case when t0 = t1 then v0 else v0 + (epoch_us(ts) - epoch_us(t0))::double / (epoch_us(t1) - epoch_us(t0)) * (v1 - v0) end, 6) as value from f""")
def ts_interpolate(t):
    s = t("events").where("event_type <> 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("v"))
    q = t("events").where("event_type = 'view'").select("user_id", "event_id", "ts")
    return series.interpolated(s, q, ["user_id"], "ts", "v").select("event_id", F.round("value", 6).alias("value"))


# --- rollups and baselines -------------------------------------------------------------------------------------------

_R = "(select *, event_type = 'error' as is_floor, case when event_type <> 'error' then value end as v from events)"


@query("ts_hourly_rollup", f"""
select user_id, date_trunc('day', ts) as hour, count(*) as n_obs, count(v) as n_valid, count(*) filter (where is_floor) as n_floor, round(median(v), 6) as median,
 round(quantile_cont(v, 0.1), 6) as p10, round(quantile_cont(v, 0.9), 6) as p90, min(v) as low, max(v) as high from {_R} group by 1, 2""")
def ts_hourly_rollup(t):
    r = rollup.hourly(t("events"), "user_id", "ts", "value", F.col("event_type") == "error", unit="day")
    return r.withColumns({c: F.round(c, 6) for c in ("median", "p10", "p90")})


@query("ts_incremental", f"""
select user_id, date_trunc('hour', ts) as hour, count(*) as n_obs, count(v) as n_valid, count(*) filter (where is_floor) as n_floor, round(median(v), 6) as median,
 round(quantile_cont(v, 0.1), 6) as p10, round(quantile_cont(v, 0.9), 6) as p90, min(v) as low, max(v) as high from {_R} group by 1, 2""")
def ts_incremental(t):
    """A rollup of what was there before the 20th, refreshed from the 15th on with all rows: equals the rollup of all."""
    e, floor = t("events"), F.col("event_type") == "error"
    old = rollup.hourly(e.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")), "user_id", "ts", "value", floor)
    r = rollup.refreshed(old, e, datetime(2024, 1, 15, 10, 30), "user_id", "ts", "value", floor)
    return r.withColumns({c: F.round(c, 6) for c in ("median", "p10", "p90")})


@query("ts_first_hour", "select date_trunc('hour', t) as hour, count(*) as new_entities from (select user_id, min(ts) as t from events group by 1) group by 1")
def ts_first_hour(t):
    return rollup.first_seen_per_hour(t("events"), "user_id", "ts")


@query("ts_baseline", f"""
with b as (select user_id, count(v) as n_obs, count(*) filter (where is_floor) as n_floor, count(distinct cast(ts as date)) as n_days, avg(v) as mean, stddev_pop(v) as sd, median(v) as median,
  quantile_cont(v, 0.05) as p5, quantile_cont(v, 0.95) as p95 from {_R} group by 1 having count(v) >= 50 and count(distinct cast(ts as date)) >= 2),
m as (select user_id, 1.4826 * median(abs(v - median)) as robust_sd from {_R} join b using (user_id) where v is not null group by 1)
select user_id, n_obs, n_floor, n_days, round(mean, 6) as mean, round(sd, 6) as sd, round(median, 6) as median, round(p5, 6) as p5, round(p95, 6) as p95, round(robust_sd, 6) as robust_sd from b join m using (user_id)""")
def ts_baseline(t):
    b = rollup.baseline(t("events"), "user_id", "ts", "value", F.col("event_type") == "error", 50, 2)
    return b.withColumns({c: F.round(c, 6) for c in ("mean", "sd", "median", "p5", "p95", "robust_sd")})


@query("ts_presence_class", "select user_id, h as hours, case when h <= 2 then 'transient' when h / 720.0 >= 0.9 then 'permanent' when h / 720.0 >= 0.1 then 'regular' else 'occasional' end as presence from (select user_id, count(distinct date_trunc('hour', ts)) as h from events group by 1)")
def ts_presence_class(t):
    return rollup.presence_class(t("events"), "user_id", "ts", 720)


@query("ts_threshold_sweep", """
with m as (select user_id, median(value) as md from events group by 1), e as (select user_id, value, md from events join m using (user_id)), l as (select unnest([5.0, 10.0, 25.0, 60.0]) as threshold)
select user_id, cast(threshold as double) as threshold, count(*) as n, count(*) filter (where abs(value - md) >= threshold) as above, round(count(*) filter (where abs(value - md) >= threshold)::double / count(*), 6) as share from e, l group by 1, 2""")
def ts_threshold_sweep(t):
    e = t("events")
    m = e.groupBy("user_id").agg(stats.quantile("value", 0.5).alias("md"))
    return stats.exceedance(e.join(m, "user_id"), ["user_id"], "value", "md", [5, 10, 25, 60]).withColumn("share", F.round("share", 6))


# --- change data -----------------------------------------------------------------------------------------------------

_H = "(select o_custkey, o_orderdate, o_orderkey, nullif(o_orderstatus, 'P') as status, o_orderpriority as priority from orders)"


def _history(t):
    return t("orders").select("o_custkey", "o_orderdate", "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.col("o_orderpriority").alias("priority"))


@query("ts_change_timeline", f"""
with l as (select o_custkey, o_orderdate, o_orderkey, field, val from (select o_custkey, o_orderdate, o_orderkey, cast(status as varchar) as status, cast(priority as varchar) as priority from {_H}) unpivot (val for field in (status, priority))),
n as (select o_custkey, field, val as old, lead(val) over w as new, lead(o_orderdate) over w as at_ from l window w as (partition by o_custkey, field order by o_orderdate, o_orderkey))
select o_custkey, field, at_ as "at", old, new from n where new <> old""")
def ts_change_timeline(t):
    return changes.timeline(_history(t), ["o_custkey"], "o_orderdate", "o_orderkey", ["status", "priority"])


@query("ts_merge_config", f"""
with k as (select *, last_value(status ignore nulls) over w as s0, last_value(priority ignore nulls) over w as p0 from {_H} window w as (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and 1 preceding))
select o_orderkey, coalesce(status, s0) as status, coalesce(priority, p0) as priority, coalesce(status <> s0, false) or coalesce(priority <> p0, false) as is_change from k""")
def ts_merge_config(t):
    return changes.merged_state(_history(t), ["o_custkey"], "o_orderdate", "o_orderkey", ["status", "priority"]).select("o_orderkey", "status", "priority", "is_change")


_PERIODS = """
c as (select *, case when o_orderstatus is distinct from lag(o_orderstatus) over w then 1 else 0 end as ch from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)),
r as (select *, sum(ch) over (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding) as run from c),
p as (select o_custkey, run, any_value(o_orderstatus) as o_orderstatus, min(o_orderdate) as valid_from, count(*) as n from r group by 1, 2),
v as (select *, lead(valid_from) over (partition by o_custkey order by run) as valid_to from p)"""


@query("ts_security_periods", f"with {_PERIODS} select o_custkey, o_orderstatus, valid_from, valid_to, n from v")
def ts_security_periods(t):
    return changes.validity(t("orders"), ["o_custkey"], "o_orderdate", "o_orderkey", "o_orderstatus").drop("period")


@query("ts_security_events", f"""
with {_PERIODS}, k as (select *, case o_orderstatus when 'O' then 0 when 'P' then 1 when 'F' then 2 end as rk from v),
e as (select o_custkey, valid_from as at_, lag(o_orderstatus) over w as old, o_orderstatus as new, rk, lag(rk) over w as was from k window w as (partition by o_custkey order by run))
select o_custkey, at_ as "at", old, new, case when rk < was then 'high' when rk > was then 'info' else 'low' end as severity from e where old is not null""")
def ts_security_events(t):
    p = changes.validity(t("orders"), ["o_custkey"], "o_orderdate", "o_orderkey", "o_orderstatus")
    return changes.period_events(p, ["o_custkey"], "o_orderstatus", S.choose(F.col("o_orderstatus"), {"O": 0, "P": 1, "F": 2}))


# --- merges ----------------------------------------------------------------------------------------------------------


def _halves(t):
    l = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", "l_returnflag")
    return l.where("l_linenumber <= 4"), l.where("l_linenumber >= 3").withColumn("l_quantity", F.col("l_quantity") + 1)


_STORED = "(select l_orderkey, l_linenumber, l_quantity, l_shipdate, l_returnflag from lineitem where l_linenumber <= 4)"
_STAGED = "(select l_orderkey, l_linenumber, l_quantity + 1 as l_quantity, l_shipdate, l_returnflag from lineitem where l_linenumber >= 3)"


@query("upsert_insert_ignore", f"select l_orderkey, l_linenumber, min(l_quantity) as l_quantity from {_STORED} group by 1, 2 union all select l_orderkey, l_linenumber, min(l_quantity) from {_STAGED} s where not exists (select 1 from {_STORED} o where o.l_orderkey = s.l_orderkey and o.l_linenumber = s.l_linenumber) group by 1, 2")
def upsert_insert_ignore(t):
    stored, staged = _halves(t)
    return merge.insert_ignore(stored, staged, ["l_orderkey", "l_linenumber"], ["l_quantity"]).select("l_orderkey", "l_linenumber", "l_quantity")


@query("upsert_insert_counts", f"select staged, inserted, staged - inserted as conflicts from (select count(*) as staged from {_STAGED}), (select count(*) as inserted from (select distinct l_orderkey, l_linenumber from {_STAGED} where l_linenumber > 4))")
def upsert_insert_counts(t):
    stored, staged = _halves(t)
    return merge.insert_counts(stored, staged, ["l_orderkey", "l_linenumber"])


_AGG = "(select l_partkey, l_returnflag, count(*) as polls, sum(l_quantity) as total from lineitem where {} group by 1, 2)"


def _partials(t):
    by = lambda c: t("lineitem").where(c).groupBy("l_partkey", "l_returnflag").agg(F.count("*").alias("polls"), F.sum("l_quantity").alias("total"))
    return by("l_linenumber <= 4"), by("l_linenumber >= 3")


@query("upsert_fuller_wins", f"""
select coalesce(a.l_partkey, b.l_partkey) as l_partkey, coalesce(a.l_returnflag, b.l_returnflag) as l_returnflag, case when a.polls is null or b.polls > a.polls then b.polls else a.polls end as polls,
 case when a.polls is null or b.polls > a.polls then b.total else a.total end as total from {_AGG.format('l_linenumber <= 4')} a full join {_AGG.format('l_linenumber >= 3')} b on a.l_partkey = b.l_partkey and a.l_returnflag = b.l_returnflag""")
def upsert_fuller_wins(t):
    return merge.best_wins(*_partials(t), ["l_partkey", "l_returnflag"], "polls")


@query("upsert_newest_wins", f"""
with u as (select *, 0 as st from {_STORED} union all select *, 1 as st from {_STAGED})
select l_orderkey, min(l_shipdate) as seen_first, max(l_shipdate) as seen_last, arg_max(l_returnflag, (l_shipdate, 1 - st, l_returnflag)) as l_returnflag from u group by 1""")
def upsert_newest_wins(t):
    stored, staged = (x.select("l_orderkey", "l_shipdate", F.col("l_shipdate").alias("seen_first"), F.col("l_shipdate").alias("seen_last"), "l_returnflag") for x in _halves(t))
    return merge.newest_wins(stored, staged, ["l_orderkey"], "l_shipdate", ["l_returnflag"], "seen_first", "seen_last")


@query("upsert_widen", "select l_suppkey, l_returnflag, min(l_shipdate) as seen_first, max(l_shipdate) as seen_last from lineitem group by 1, 2")
def upsert_widen(t):
    by = lambda c: t("lineitem").where(c).groupBy("l_suppkey", "l_returnflag").agg(F.min("l_shipdate").alias("seen_first"), F.max("l_shipdate").alias("seen_last"))
    return merge.widened(by("l_linenumber <= 3"), by("l_linenumber > 3"), ["l_suppkey", "l_returnflag"], "seen_first", "seen_last")


@query("upsert_additive", "select l_partkey, l_returnflag, count(*) as polls, max(l_quantity) as peak from lineitem group by 1, 2")
def upsert_additive(t):
    by = lambda c: t("lineitem").where(c).groupBy("l_partkey", "l_returnflag").agg(F.count("*").alias("polls"), F.max("l_quantity").alias("peak"))
    return merge.added_up(by("l_linenumber <= 3"), by("l_linenumber > 3"), ["l_partkey", "l_returnflag"], ["polls"], ["peak"])


@query("update_if_changed", f"""
select coalesce(a.l_orderkey, b.l_orderkey) as l_orderkey, coalesce(a.l_linenumber, b.l_linenumber) as l_linenumber,
 case when a.l_orderkey is null then 'insert' when b.l_orderkey is null then 'stored' when a.l_returnflag is not distinct from b.l_returnflag then 'same' else 'update' end as action
from {_STORED} a full join {_STAGED} b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber""")
def update_if_changed(t):
    return merge.changed(*_halves(t), ["l_orderkey", "l_linenumber"], ["l_returnflag"])


_WIN = "(select cast('2024-01-05' as timestamp) as lo, cast('2024-01-07' as timestamp) as hi union all select cast('2024-01-20' as timestamp), cast('2024-01-21' as timestamp))"


def _windows(t):
    pairs = F.array(*(F.struct(F.lit(a).cast("timestamp_ntz").alias("lo"), F.lit(b).cast("timestamp_ntz").alias("hi")) for a, b in (("2024-01-05", "2024-01-07"), ("2024-01-20", "2024-01-21"))))
    return t("region").limit(1).select(F.inline(pairs))


@query("stage_exclude_windows", f"select lo, hi, count(*) as excluded from events join {_WIN} w on ts >= lo and ts < hi group by 1, 2")
def stage_exclude_windows(t):
    return merge.outside_windows(t("events"), _windows(t), "ts", "lo", "hi")[1]


@query("st_late_data", f"select event_type, count(*) as n from events where not exists (select 1 from {_WIN} w where ts >= lo and ts < hi) group by 1")
def st_late_data(t):
    return merge.outside_windows(t("events"), _windows(t), "ts", "lo", "hi")[0].groupBy("event_type").agg(F.count("*").alias("n"))


# --- sorting, paging, sets -------------------------------------------------------------------------------------------


@query("topk", "select event_id, value from events order by value desc, event_id limit 20")
def topk(t):
    return paging.top(t("events").select("event_id", "value"), [F.desc("value"), "event_id"], 20)


@query("page_keyset", "select event_id, ts from events where ts < timestamp '2024-01-20' or (ts = timestamp '2024-01-20' and event_id < 100) order by ts desc, event_id desc limit 51")
def page_keyset(t):
    return paging.keyset_page(t("events").select("event_id", "ts"), "ts", "event_id", 50, before=("2024-01-20 00:00:00", 100))


@query("cursor_codec", "select event_id, rtrim(translate(base64(encode(cast(epoch_us(ts) as varchar) || '.' || cast(event_id as varchar))), '+/=', '-_ ')) as cursor from events")
def cursor_codec(t):
    return t("events").select("event_id", S.cursor(S.micros("ts"), F.col("event_id")).alias("cursor"))


@query("group_sort", "select c_custkey, count(*) over (partition by c_nationkey) as group_size, row_number() over (partition by c_nationkey order by c_custkey) as place from customer")
def group_sort(t):
    return paging.grouped_order(t("customer"), "c_nationkey", "c_custkey").select("c_custkey", "group_size", "place")


@query("set_union_distinct", "select user_id as id from events union select c_custkey from customer where c_nationkey = 3")
def set_union_distinct(t):
    return t("events").select(F.col("user_id").alias("id")).union(t("customer").where("c_nationkey = 3").select("c_custkey")).distinct()


@query("set_symmetric_diff", "(select o_custkey from orders except all select c_custkey from customer) union all (select c_custkey from customer except all select o_custkey from orders)")
def set_symmetric_diff(t):
    a, b = t("orders").select("o_custkey"), t("customer").select("c_custkey")
    return a.exceptAll(b).union(b.exceptAll(a))


@query("set_intersect_diff", "select count(*) filter (where a and b) as both_sides, count(*) filter (where a and not b) as only_a, count(*) filter (where b and not a) as only_b from (select k, bool_or(s = 0) as a, bool_or(s = 1) as b from (select distinct o_custkey as k, 0 as s from orders union select distinct user_id, 1 from events) group by k)")
def set_intersect_diff(t):
    u = t("orders").select(F.col("o_custkey").alias("k"), F.lit(True).alias("a"), F.lit(False).alias("b")).union(t("events").select("user_id", F.lit(False), F.lit(True)))
    s = u.groupBy("k").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))
    return s.agg(F.count_if(F.col("a") & F.col("b")).alias("both_sides"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(F.col("b") & ~F.col("a")).alias("only_b"))


# --- calendar and coverage -------------------------------------------------------------------------------------------


@query("cov_hour_capture", "select user_id, date_trunc('day', ts) as d, round(case when count(*) > 0 then greatest(86400.0 - max(value), 0) * count(*) filter (where event_type <> 'error') / count(*) else 0 end, 6) as captured_s from events group by 1, 2")
def cov_hour_capture(t):
    g = t("events").groupBy("user_id", F.date_trunc("day", "ts").alias("d")).agg(F.count("*").alias("polls"), F.count_if(F.col("event_type") != "error").alias("ok"), F.max("value").alias("gap"))
    return g.select("user_id", "d", F.round(calendar.hour_capture(F.col("polls"), F.col("ok"), F.lit(86400.0), F.col("gap")), 6).alias("captured_s"))


@query("cov_null_series", """
with g as (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-30', interval 1 day)) as d),
e as (select date_trunc('day', ts) as d, count(*) filter (where event_type = 'error') as errors from events where extract(day from ts) % 5 <> 0 group by 1)
select g.d, case when extract(day from g.d) % 5 <> 0 then coalesce(errors, 0) end as errors from g left join e using (d)""")
def cov_null_series(t):
    day = F.day("ts") % 5 != 0
    e = t("events").where(day).groupBy(F.date_trunc("day", "ts").alias("d")).agg(F.count_if(F.col("event_type") == "error").alias("errors"))
    span = t("region").limit(1).select(F.lit("2024-01-01").cast("timestamp").alias("lo"), F.lit("2024-01-30").cast("timestamp").alias("hi"))
    g = calendar.grid(span, [], "lo", "hi", "1 day", "d").withColumn("d", F.col("d").cast("timestamp_ntz")).withColumn("on", F.day("d") % 5 != 0)
    return calendar.masked(g, e, ["d"], ["errors"], "on").select("d", "errors")


@query("dash_busy_hours", """
with h as (select event_type, hour(ts) as h, sum(value) as v from events group by 1, 2), d as (select unnest(range(4)) as d),
r as (select event_type, ((h - d) % 24 + 24) % 24 as start, sum(v) as load from h, d group by 1, 2)
select event_type, start, round(load, 4) as load from (select *, row_number() over (partition by event_type order by load desc, start) as k from r) where k = 1""")
def dash_busy_hours(t):
    h = t("events").groupBy("event_type", F.hour("ts").cast("long").alias("h")).agg(F.sum("value").alias("v"))
    return calendar.busiest_run(h, ["event_type"], "h", "v").withColumn("load", F.round("load", 4))


# --- scalar functions ------------------------------------------------------------------------------------------------


@query("fn_rssi_valid", "select event_id, case when -cast(value as int) in (-106, -120) then null else -cast(value as int) end as valid, coalesce(-cast(value as int) in (-106, -120), false) or event_type = 'error' as floor from events".replace("cast(value as int)", "cast(floor(value) as int)"))
def fn_rssi_valid(t):
    r = -F.floor("value").cast("int")
    return t("events").select("event_id", S.level_valid(r).alias("valid"), S.is_floor(r, F.col("event_type") == "error").alias("floor"))


@query("fn_band", """
select event_id, case when k between 1 and 14 then '2.4' when k between 32 and 177 then '5' end as band,
 case when k <= 0 then null when k * 70000 < 3000000 then '2.4' when k * 70000 < 5925000 then '5' when k is not null then '6' end as freq_band, coalesce(k between 52 and 144, false) as dfs from """ + _EV)
def fn_band(t):
    k = F.col("k")
    return _events(t).select("event_id", S.band_of_channel(k.cast("string")).alias("band"), S.band_of_freq(k * 70000).alias("freq_band"), S.needs_dfs(k).alias("dfs"))


@query("fn_kismet_severity", "select event_id, case when floor(value) >= 20 then 'critical' when floor(value) >= 15 then 'high' when floor(value) >= 10 then 'medium' when floor(value) >= 5 then 'low' else 'info' end as severity from events")
def fn_kismet_severity(t):
    return t("events").select("event_id", S.alert_severity(F.floor("value")).alias("severity"))


@query("fn_mac", """
with m as (select c_custkey, printf('%012x', (c_custkey * 2654435761) % 281474976710656) as h from customer),
n as (select c_custkey, upper(substr(h,1,2)||':'||substr(h,3,2)||':'||substr(h,5,2)||':'||substr(h,7,2)||':'||substr(h,9,2)||':'||substr(h,11,2)) as mac, h from m)
select c_custkey, mac, substr(mac, 1, 8) as vendor, (cast('0x' || substr(h, 1, 2) as int) & 2) <> 0 as local from n""")
def fn_mac(t):
    h = F.lpad(F.lower(F.hex((F.col("c_custkey") * 2654435761) % 281474976710656)), 12, "0")
    mac = S.mac_normal(h)
    return t("customer").select("c_custkey", mac.alias("mac"), S.mac_vendor(mac).alias("vendor"), S.mac_is_local(mac).alias("local"))


@query("fn_lookalike", r"select a.n_name as a, b.n_name as b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_name < b.n_name where levenshtein(regexp_replace(lower(a.n_name), '[^a-z0-9]', '', 'g'), regexp_replace(lower(b.n_name), '[^a-z0-9]', '', 'g')) <= 1")
def fn_lookalike(t):
    n = t("nation")
    a, b = (n.select("n_regionkey", F.col("n_name").alias(x)) for x in ("a", "b"))
    return a.join(b, "n_regionkey").where(F.col("a") < F.col("b")).where(S.lookalike(F.col("a"), F.col("b"))).select("a", "b")


@query("fn_alert_hash", "select event_id, sha1(coalesce(event_type, '') || '|' || coalesce(cast(user_id as varchar), '') || '|' || coalesce(props, '')) as hash from events")
def fn_alert_hash(t):
    return t("events").select("event_id", S.stable_hash(F.col("event_type"), F.col("user_id"), F.col("props")).alias("hash"))


@query("fn_coerce", "select event_id, coalesce(try_cast(case when event_id % 3 = 0 then props else cast(event_id as varchar) end as bigint), 0) as n from events")
def fn_coerce(t):
    return t("events").select("event_id", S.counter(F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(F.col("event_id").cast("string"))).alias("n"))


@query("sink_csv_safe", r"select doc_id, case when regexp_matches(text, '^[=+\-@\t\r]') then '''' || text else text end as cell from documents")
def sink_csv_safe(t):
    return t("documents").select("doc_id", S.csv_safe(F.col("text")).alias("cell"))


@query("fn_redact", r"select doc_id, md5(regexp_replace(text, '(?i)\b([0-9a-f]{2}(?::[0-9a-f]{2}){2})(?::[0-9a-f]{2}){3}\b', '\1:xx:xx:xx', 'g')) as masked from documents")
def fn_redact(t):
    return t("documents").select("doc_id", F.md5(S.mask_macs(F.col("text")).cast("binary")).alias("masked"))


def _mask(positions) -> int:
    return sum(1 << p for p in positions)


_KIND = f"""case when b & {_mask(S.PROTECTED_BITS)} = 0 then 'open' when b & {_mask(S.WEP_BITS)} <> 0 then 'wep'
 when b & 4 <> 0 and b & 8 <> 0 then 'wpa1_mixed' when b & 4 <> 0 then 'wpa1' when b & {_mask(S.TKIP_BITS)} <> 0 then 'tkip' else 'rest' end"""


@query("fn_security_level", f"""
with x as (select event_id, (event_id * 7) % 1024 + 1 as b from events), k as (select event_id, {_KIND} as kind from x)
select event_id, kind, case kind when 'open' then 'open' when 'rest' then 'unknown' else 'legacy' end as level from k""")
def fn_security_level(t):
    bits = (F.col("event_id") * 7) % 1024 + 1
    kind = S.security_kind(F.lit(None).cast("string"), bits)
    shown = F.when(kind == "unknown", "rest").otherwise(kind)
    return t("events").select("event_id", shown.alias("kind"), S.security_level(kind, F.lit(None).cast("boolean")).alias("level"))
