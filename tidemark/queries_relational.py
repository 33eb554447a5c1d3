"""The remaining relational shapes bound to the generic tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import intervals, ranks, series
from tidemark.queries import _EV, _events, query

_BY = "(partition by user_id order by ts, event_id)"


def _w(*more):
    return Window.partitionBy("user_id").orderBy("ts", "event_id", *more)


@query("join_cross_scalar", "select user_id, count(*) as n, round(count(*)::double / (select count(*) from events), 8) as share from events group by 1")
def join_cross_scalar(t):
    total = t("events").agg(F.count("*").alias("total"))
    return t("events").groupBy("user_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("user_id", "n", F.round(F.col("n") / F.col("total"), 8).alias("share"))


@query("join_lateral_agg", "select s_suppkey, (select count(*) from lineitem where l_suppkey = s_suppkey) as n, (select max(l_shipdate) from lineitem where l_suppkey = s_suppkey) as last from supplier")
def join_lateral_agg(t):
    l = t("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"), F.max("l_shipdate").alias("last"))
    return t("supplier").select("s_suppkey").join(l, "s_suppkey", "left").select("s_suppkey", F.coalesce("n", F.lit(0)).alias("n"), "last")


@query("join_state_at", """
with c as (select user_id, ts, max_by(event_type, event_id) as state from events where event_type <> 'view' group by 1, 2), v as (select user_id, event_id, ts from events where event_type = 'view'),
b as (select v.*, c.state as past from v asof left join c on v.user_id = c.user_id and v.ts >= c.ts), f as (select b.*, c.state as next from b asof left join c on b.user_id = c.user_id and b.ts < c.ts)
select event_id, coalesce(past, next, 'unknown') as state from f""")
def join_state_at(t):
    e = t("events")
    c = e.where("event_type <> 'view'").groupBy("user_id", F.col("ts").alias("at")).agg(F.max_by("event_type", "event_id").alias("state"))
    v = e.where("event_type = 'view'").select("user_id", "event_id", "ts")
    past = intervals.asof(v, c, ["user_id"], "ts", "at", ["state"]).withColumnRenamed("state", "past")
    both = intervals.asof(past, c, ["user_id"], "ts", "at", ["state"], forward=True)
    return both.select("event_id", F.coalesce("past", "state", F.lit("unknown")).alias("state"))


@query("join_asof_set", f"""
with g as (select *, count(case when event_type = 'signup' then 1 end) over (partition by user_id order by ts, event_id rows between current row and unbounded following) as grp from events)
select event_id, max(case when event_type = 'signup' then value end) over (partition by user_id, grp) as next_value from g""")
def join_asof_set(t):
    mark = F.when(F.col("event_type") == "signup", F.col("value"))
    g = t("events").withColumn("grp", F.count(mark).over(_w().rowsBetween(0, Window.unboundedFollowing)))
    return g.select("event_id", F.max(mark).over(Window.partitionBy("user_id", "grp")).alias("next_value"))


@query("join_self_adjacent", "select a.event_id as a, b.event_id as b from (select *, row_number() over w as n from events window w as (partition by user_id order by ts, event_id)) a join (select *, row_number() over w as n from events window w as (partition by user_id order by ts, event_id)) b on a.user_id = b.user_id and b.n = a.n + 1 and a.event_type <> b.event_type")
def join_self_adjacent(t):
    e = t("events").withColumns({"b": F.lead("event_id").over(_w()), "kind": F.lead("event_type").over(_w())})
    return e.where("kind <> event_type").select(F.col("event_id").alias("a"), "b")


@query("join_self_pairs", "select a.user_id, count(*) as n from (select distinct user_id, cast(ts as date) as d from events where event_type = 'click') a join (select distinct user_id, cast(ts as date) as d from events where event_type = 'error') b on a.user_id = b.user_id and a.d = b.d group by 1")
def join_self_pairs(t):
    days = lambda k: t("events").where(F.col("event_type") == k).select("user_id", F.to_date("ts").alias("d")).distinct()
    return days("click").join(days("error"), ["user_id", "d"]).groupBy("user_id").agg(F.count("*").alias("n"))


@query("join_self_range", """
select x.user_id as a, min_by(y.user_id, (y.f, y.user_id)) as b from (select user_id, user_id % 10 as g, max(ts) as l from events group by 1) x
join (select user_id, user_id % 10 as g, min(ts) as f from events group by 1) y on x.g = y.g and x.user_id <> y.user_id and y.f >= x.l - interval 29 day and y.f < x.l group by 1""")
def join_self_range(t):
    s = t("events").groupBy("user_id").agg(F.min("ts").alias("f"), F.max("ts").alias("l")).withColumn("g", F.col("user_id") % 10)
    x = s.select("g", F.col("user_id").alias("a"), (F.col("l") - F.expr("interval 29 days")).alias("lo"), F.col("l").alias("hi"))
    y = s.select("g", F.col("user_id").alias("b"), "f")
    near = ranks.next_rows(x, y, ["g"], "lo", "f", "b", 2).where("a <> b and f < hi")  # the first two, as one may be the row itself
    return near.groupBy("a").agg(F.min_by("b", F.struct("f", "b")).alias("b"))


@query("join_same_tail", "select c_custkey from customer a where c_custkey % 2 = 0 and exists (select 1 from customer b where b.c_custkey % 2 = 1 and right(b.c_name, 2) = right(a.c_name, 2))")
def join_same_tail(t):
    tail = F.substring("c_name", -2, 2)
    a = t("customer").where("c_custkey % 2 = 0").select("c_custkey", tail.alias("tail"))
    return a.join(t("customer").where("c_custkey % 2 = 1").select(tail.alias("tail")), "tail", "left_semi").select("c_custkey")


@query("join_dim_prefix", "select p_partkey from part where starts_with(lower(p_type), 'promo') or starts_with(lower(p_type), 'small')")
def join_dim_prefix(t):
    kind = F.lower("p_type")
    return t("part").where(F.exists(F.array(F.lit("promo"), F.lit("small")), lambda v: kind.startswith(v))).select("p_partkey")


@query("join_distinct_function", "select o_orderkey, length(o_orderpriority) * 10 + length(o_orderstatus) as score from orders")
def join_distinct_function(t):
    """A costly function is worked out once for each distinct input and joined back null-safe."""
    k = t("orders").select("o_orderpriority", "o_orderstatus").distinct().withColumn("score", (F.length("o_orderpriority") * 10 + F.length("o_orderstatus")).cast("long"))
    k = k.select(F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"), "score")
    return t("orders").join(k, F.col("o_orderpriority").eqNullSafe(F.col("p")) & F.col("o_orderstatus").eqNullSafe(F.col("s"))).select("o_orderkey", "score")


@query("agg_distinct", "select event_type, count(distinct user_id) as users, count(distinct user_id) filter (where value > 50) as large from events group by 1")
def agg_distinct(t):
    return t("events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.when(F.col("value") > 50, F.col("user_id"))).alias("large"))


@query("agg_stddev_pop", "select user_id, round(stddev_pop(value), 6) as sd from events group by 1")
def agg_stddev_pop(t):
    return t("events").groupBy("user_id").agg(F.round(F.stddev_pop("value"), 6).alias("sd"))


@query("agg_bool", "select user_id, bool_or(event_type = 'error') as ever, bool_and(value > 1) as always from events group by 1")
def agg_bool(t):
    return t("events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "error").alias("ever"), F.bool_and(F.col("value") > 1).alias("always"))


@query("agg_distinct_on", "select user_id, event_id, value from (select *, row_number() over (partition by user_id order by value desc, event_id) as k from events) where k = 1")
def agg_distinct_on(t):
    return series.top_each(t("events"), ["user_id"], [F.desc("value"), "event_id"]).select("user_id", "event_id", "value")


@query("agg_manual_rollup", "select coalesce(c_mktsegment, 'all') as segment, coalesce(cast(c_nationkey as varchar), 'all') as nation, count(*) as n from customer group by rollup (c_mktsegment, c_nationkey)")
def agg_manual_rollup(t):
    r = t("customer").rollup("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))
    return r.select(F.coalesce("c_mktsegment", F.lit("all")).alias("segment"), F.coalesce(F.col("c_nationkey").cast("string"), F.lit("all")).alias("nation"), "n")


@query("agg_qbss_or_client", f"select user_id, case when bool_or(event_type = 'signup') then max(case when event_type = 'signup' then k end) else max(k) end as clients from {_EV} group by 1")
def agg_qbss_or_client(t):
    own = F.col("event_type") == "signup"
    return _events(t).groupBy("user_id").agg(F.when(F.bool_or(own), F.max(F.when(own, F.col("k")))).otherwise(F.max("k")).alias("clients"))


@query("agg_json", "select user_id, count(*) as n, max(k) as k from " + _EV + " group by 1")
def agg_json(t):
    """Counts by way of a JSON document that is built and read back."""
    doc = F.to_json(F.struct(F.count("*").alias("n"), F.max("k").alias("k")))
    j = _events(t).groupBy("user_id").agg(doc.alias("doc"))
    return j.select("user_id", F.get_json_object("doc", "$.n").cast("long").alias("n"), F.get_json_object("doc", "$.k").cast("long").alias("k"))


@query("win_lead_default", f"select event_id, lead(ts, 1, timestamp '9999-01-01') over {_BY} as until from events")
def win_lead_default(t):
    return t("events").select("event_id", F.coalesce(F.lead("ts").over(_w()), F.lit("9999-01-01").cast("timestamp_ntz")).alias("until"))


@query("win_lead_nulls_last", "select o_orderkey, lead(o_orderkey) over (partition by o_custkey order by nullif(o_orderstatus, 'P') nulls last, o_orderkey) as next from orders")
def win_lead_nulls_last(t):
    w = Window.partitionBy("o_custkey").orderBy(F.asc_nulls_last("s"), "o_orderkey")
    return t("orders").withColumn("s", F.nullif("o_orderstatus", F.lit("P"))).select("o_orderkey", F.lead("o_orderkey").over(w).alias("next"))


@query("win_running_sum_groups", f"select event_id, cast(sum(case when event_type = 'error' then 1 else 0 end) over {_BY} as bigint) as grp from events")
def win_running_sum_groups(t):
    return t("events").select("event_id", F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).over(_w().rowsBetween(Window.unboundedPreceding, 0)).alias("grp"))


@query("win_count_filter_running", f"select event_id, count(*) filter (where value > 30) over {_BY} as n from events")
def win_count_filter_running(t):
    return t("events").select("event_id", F.count(F.when(F.col("value") > 30, 1)).over(_w().rowsBetween(Window.unboundedPreceding, 0)).alias("n"))


@query("win_frame_following", "select event_id, min(value) over (partition by user_id order by ts, event_id rows between current row and unbounded following) as least from events")
def win_frame_following(t):
    return t("events").select("event_id", F.min("value").over(_w().rowsBetween(0, Window.unboundedFollowing)).alias("least"))


@query("win_partition_count", "select l_orderkey, l_linenumber, l_partkey, count(*) over (partition by l_orderkey) as n from lineitem")
def win_partition_count(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.count("*").over(Window.partitionBy("l_orderkey")).alias("n"))


@query("win_total_count", "select c_custkey, (select count(*) from customer where c_acctbal < 0) as total from customer where c_acctbal < 0 order by c_acctbal, c_custkey limit 10")
def win_total_count(t):
    some = t("customer").where("c_acctbal < 0")
    return some.orderBy("c_acctbal", "c_custkey").limit(10).select("c_custkey").crossJoin(F.broadcast(some.agg(F.count("*").alias("total"))))


@query("win_max_in_group", "select event_id, max(value) over (partition by user_id, cast(ts as date)) as peak from events")
def win_max_in_group(t):
    return t("events").select("event_id", F.max("value").over(Window.partitionBy("user_id", F.to_date("ts"))).alias("peak"))


@query("win_burst_split", f"""
with f as (select *, case when epoch_us(ts) - epoch_us(lag(ts) over w) > 7200000000 then 1 else 0 end as n from {_EV} window w as {_BY}),
e as (select *, sum(n) over (partition by user_id order by ts, event_id rows unbounded preceding) as g from f)
select user_id, cast(g as bigint) as episode, count(*) as frames, count(distinct k) as channels, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) as seconds from e group by 1, 2""")
def win_burst_split(t):
    b = series.episodes(_events(t), ["user_id"], "ts", "event_id", 7200, F.count_distinct("k").alias("channels"))
    return b.select("user_id", "episode", F.col("n").alias("frames"), "channels", F.round("seconds", 3).alias("seconds"))


@query("sort_multi", "select o_orderkey from orders order by case o_orderstatus when 'O' then 0 when 'P' then 1 else 2 end, o_totalprice desc nulls last, o_orderkey")
def sort_multi(t):
    return t("orders").orderBy(S.choose(F.col("o_orderstatus"), {"O": 0, "P": 1}, 2), F.desc_nulls_last("o_totalprice"), "o_orderkey").select("o_orderkey")


@query("set_union_all", "select 'order' as kind, o_orderkey as id from orders union all select 'event', event_id from events")
def set_union_all(t):
    return t("orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id")).unionByName(t("events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id")))


@query("set_top1_of_union", "select user_id, max_by(src, (at_, src)) as src from (select user_id, 'e' as src, max(ts) as at_ from events where event_type = 'error' group by 1 union all select user_id, 'v', max(ts) from events where event_type = 'view' group by 1) group by 1")
def set_top1_of_union(t):
    last = lambda k, s: t("events").where(F.col("event_type") == k).groupBy("user_id").agg(F.max("ts").alias("at")).withColumn("src", F.lit(s))
    return last("error", "e").union(last("view", "v")).groupBy("user_id").agg(F.max_by("src", F.struct("at", "src")).alias("src"))


@query("set_contains", "select user_id, list_has_all(list(distinct event_type), ['error', 'signup']) as both_seen from events group by 1")
def set_contains(t):
    need = F.array(F.lit("error"), F.lit("signup"))
    return t("events").groupBy("user_id").agg((F.size(F.array_except(need, F.collect_set("event_type"))) == 0).alias("both_seen"))


@query("set_multiset_eq", "select o_custkey, list_sort(list(o_orderstatus)) = ['F', 'O'] as one_each from orders group by 1")
def set_multiset_eq(t):
    return t("orders").groupBy("o_custkey").agg((F.array_sort(F.collect_list("o_orderstatus")) == F.array(F.lit("F"), F.lit("O"))).alias("one_each"))


@query("ts_interval_clip_sum", """
select o_custkey, round(sum(greatest(epoch(least(o_orderdate + interval 20 day, timestamp '1997-01-01')) - epoch(greatest(o_orderdate, timestamp '1996-01-01')), 0)), 3) as seconds from orders group by 1""")
def ts_interval_clip_sum(t):
    o = t("orders").withColumns({"hi": F.col("o_orderdate") + F.expr("interval 20 days"), "a": F.lit("1996-01-01").cast("timestamp_ntz"), "b": F.lit("1997-01-01").cast("timestamp_ntz")})
    return o.groupBy("o_custkey").agg(F.round(F.sum(intervals.overlap_seconds("o_orderdate", "hi", "a", "b")), 3).alias("seconds"))


@query("ts_ever_flag", f"select event_id, bool_or(event_type = 'error') over {_BY} as ever from events")
def ts_ever_flag(t):
    return t("events").select("event_id", F.bool_or(F.col("event_type") == "error").over(_w().rowsBetween(Window.unboundedPreceding, 0)).alias("ever"))


@query("label_write", "select doc_id, case when doc_id % 3 = 0 then 'kept' else 'note ' || cast(quality as varchar) end as note from labels")
def label_write(t):
    from tidemark.operators.merge import keep_note

    return t("labels").select("doc_id", keep_note(F.concat(F.lit("note "), F.col("quality").cast("string")), F.lit("kept"), F.col("doc_id") % 3 == 0).alias("note"))


@query("network_allow_append", "select user_id, array_to_string(list_sort(list_distinct(list_append(list(event_type), 'allowed'))), ',') as allowed from events group by 1")
def network_allow_append(t):
    grown = F.array_sort(F.array_distinct(F.array_append(F.collect_set("event_type"), F.lit("allowed"))))
    return t("events").groupBy("user_id").agg(F.array_join(grown, ",").alias("allowed"))


@query("config_version_next", "select c_nationkey, max(c_custkey) + 1 as next_version from customer group by 1")
def config_version_next(t):
    return t("customer").groupBy("c_nationkey").agg((F.max("c_custkey") + 1).alias("next_version"))


@query("upsert_newer_wins", """
with u as (select l_partkey, l_suppkey, l_shipdate, l_quantity, l_linenumber >= 4 as staged, l_orderkey, l_linenumber from lineitem)
select l_partkey, l_suppkey, l_shipdate, l_quantity from (select *, row_number() over (partition by l_partkey, l_suppkey order by l_shipdate desc, staged, l_orderkey, l_linenumber, l_quantity) as k from u) where k = 1""")
def upsert_newer_wins(t):
    from tidemark.operators.merge import best_wins

    l = t("lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_orderkey", "l_linenumber")
    out = best_wins(l.where("l_linenumber < 4"), l.where("l_linenumber >= 4"), ["l_partkey", "l_suppkey"], "l_shipdate", ["l_orderkey", "l_linenumber", "l_quantity"])
    return out.select("l_partkey", "l_suppkey", "l_shipdate", "l_quantity")


@query("backfill_seq", f"select e.event_id, coalesce(case when e.k > 50 then null else e.k end, o.o_custkey) as seq from {_EV} e left join orders o on o.o_orderkey = e.event_id")
def backfill_seq(t):
    e = _events(t).withColumn("seq", F.when(F.col("k") <= 50, F.col("k")))
    o = t("orders").select(F.col("o_orderkey").alias("event_id"), "o_custkey")
    return e.join(o, "event_id", "left").select("event_id", F.coalesce("seq", "o_custkey").alias("seq"))


@query("ap_only_filter", "select l_orderkey, l_linenumber, l_partkey from lineitem where exists (select 1 from part where p_partkey = l_partkey and p_size < 5)")
def ap_only_filter(t):
    some = t("part").where("p_size < 5").select(F.col("p_partkey").alias("l_partkey"))
    return t("lineitem").join(some, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("fn_event_label", "select event_id, coalesce(case event_type when 'error' then 'Failure' when 'signup' then 'New' end, event_type) as label from events")
def fn_event_label(t):
    kind = F.col("event_type")
    return t("events").select("event_id", F.coalesce(S.choose(kind, {"error": "Failure", "signup": "New"}), kind).alias("label"))


@query("fn_grade_deauth", "select event_id, ['info', 'low', 'medium', 'high', 'critical'][least(cast(floor(value / 20) as int) % 4 + 1 + (event_id % 2)::int, 5)] as severity from events")
def fn_grade_deauth(t):
    names = F.array(*map(F.lit, S.SEVERITIES))
    base = F.element_at(names, (F.floor(F.col("value") / 20).cast("int") % 4 + 1).cast("int"))
    return t("events").select("event_id", S.raised(base, F.col("event_id") % 2).alias("severity"))


@query("dash_lookup_small", "select s_nationkey, string_agg(cast(s_suppkey as varchar), ',' order by s_suppkey) as ids from supplier group by 1")
def dash_lookup_small(t):
    ids = F.transform(F.array_sort(F.collect_list("s_suppkey")), lambda x: x.cast("string"))
    return t("supplier").groupBy("s_nationkey").agg(F.array_join(ids, ",").alias("ids"))


@query("retention_cutoff", "select event_id from events where ts >= timestamp '2024-01-25'")
def retention_cutoff(t):
    return t("events").where(F.col("ts") >= F.lit("2024-01-25").cast("timestamp_ntz")).select("event_id")
