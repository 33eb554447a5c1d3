"""Hand-computed cases of the operators."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import calendar, changes, detect, intervals, merge, rollup, series, stats


def at(text):
    return datetime.fromisoformat(f"2024-03-01 {text}")


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_hourly_rollup_censors_floors(spark):
    readings = [(-50, None), (-52, None), (-54, None), (-56, None), (-58, None), (-106, None), (-70, True), (None, None)]
    df = spark.createDataFrame([("a", at("10:05:00"), r, f) for r, f in readings], "e string, ts timestamp_ntz, r int, flag boolean")
    row = rollup.hourly(df, "e", "ts", "r", S.is_floor(F.col("r"), F.col("flag"))).first()
    assert (row.n_obs, row.n_valid, row.n_floor, row.low, row.high) == (8, 5, 2, -58, -50)
    assert [round(x, 6) for x in (row.median, row.p10, row.p90)] == [-54, -57.2, -50.8]


def test_gap_is_split_over_hours(spark):
    df = spark.createDataFrame([(1, at("10:59:30"), 1), (1, at("12:20:00"), 2), (1, at("12:20:30"), 3)], "k int, ts timestamp_ntz, id int")
    g = series.gaps(df, ["k"], "ts", "id", 90)
    assert [r.seconds for r in g.collect()] == [4830.0]
    assert [r.seconds_in_hour for r in series.split_by_hour(g, "start_at", "end_at").orderBy("hour").collect()] == [30.0, 3600.0, 1200.0]


def test_silence_of_exactly_the_gap_does_not_end_an_episode(spark):
    df = spark.createDataFrame([(1, at("10:00:00"), 1), (1, at("10:05:00"), 2), (1, at("10:10:01"), 3)], "k int, ts timestamp_ntz, id int")
    assert [r.n for r in series.episodes(df, ["k"], "ts", "id", 300).orderBy("first_at").collect()] == [2, 1]


def test_abutting_intervals_merge(spark):
    df = spark.createDataFrame([(1, at("10:00:00"), at("11:00:00")), (1, at("11:00:00"), at("12:00:00")), (1, at("12:00:01"), at("12:30:00"))], "k int, lo timestamp_ntz, hi timestamp_ntz")
    assert [(r.lo.hour, r.hi.hour, r.n) for r in intervals.merged(df, ["k"], "lo", "hi").orderBy("lo").collect()] == [(10, 12, 2), (12, 12, 1)]


def test_sample_at_a_change_has_the_new_state(spark):
    c = spark.createDataFrame([(1, at("10:00:00"), "old"), (1, at("11:00:00"), "new")], "k int, at timestamp_ntz, s string")
    q = spark.createDataFrame([(1, at("11:00:00"), 7), (1, at("09:00:00"), 8)], "k int, ts timestamp_ntz, id int")
    assert {r.id: r.s for r in intervals.asof(q, c, ["k"], "ts", "at", ["s"]).collect()} == {7: "new", 8: None}
    assert {r.id: r.s for r in intervals.asof(q, c, ["k"], "ts", "at", ["s"], forward=True).collect()} == {7: None, 8: "old"}


def test_unknown_is_no_change(spark):
    h = spark.createDataFrame([(1, at("10:00:00"), 1, "a"), (1, at("11:00:00"), 2, None), (1, at("12:00:00"), 3, "a"), (1, at("13:00:00"), 4, "b")], "k int, ts timestamp_ntz, id int, f string")
    assert [(r["at"].hour, r.old, r.new) for r in changes.timeline(h, ["k"], "ts", "id", ["f"]).collect()] == [(13, "a", "b")]


def test_merges_are_idempotent(spark):
    stored = spark.createDataFrame([(1, 5, "x"), (2, 3, "y")], "k int, polls int, v string")
    staged = spark.createDataFrame([(1, 5, "z"), (2, 4, "w"), (3, 1, "n")], "k int, polls int, v string")
    once = merge.best_wins(stored, staged, ["k"], "polls")
    assert sorted(map(tuple, once.collect())) == [(1, 5, "x"), (2, 4, "w"), (3, 1, "n")]
    assert merge.best_wins(once, staged, ["k"], "polls").exceptAll(once).count() == 0
    kept = merge.insert_ignore(stored, staged, ["k"], ["v"])
    assert sorted(map(tuple, kept.collect())) == [(1, 5, "x"), (2, 3, "y"), (3, 1, "n")]
    assert {r.k: r.action for r in merge.changed(stored, staged, ["k"], ["polls", "v"]).collect()} == {1: "update", 2: "update", 3: "insert"}


def test_buckets_follow_clock_changes():
    spring = calendar.buckets("30d", datetime(2024, 4, 10, 12, tzinfo=timezone.utc), "Europe/Bratislava")
    assert {(b - a).total_seconds() / 3600 for a, b in spring} == {23.0, 24.0}
    autumn = calendar.buckets("7d", datetime(2024, 10, 28, 12, tzinfo=timezone.utc), "Europe/Bratislava")
    assert {(b - a).total_seconds() / 3600 for a, b in autumn} == {6.0, 7.0}


@pytest.mark.parametrize(("mean", "floor", "want"), [(0.0, 3, 3), (1.0, 3, 6), (5.0, 3, 14), (0.01, 3, 3)])
def test_poisson_threshold(spark, mean, floor, want):
    import math

    assert value(spark, S.poisson_threshold(F.lit(mean), 0.001, floor)) == want
    if mean:
        tail = lambda x: 1 - sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(x))
        assert tail(want) < 0.001 and (want == floor or tail(want - 1) >= 0.001)


@pytest.mark.parametrize(("text", "bits", "want"), [("Open", 0, "open"), ("WPA2-PSK", 0, "psk"), (None, None, "unknown"), (None, 1 << 38, "psk"), (None, (1 << 38) | (1 << 44), "transition"), (None, 0b1100, "wpa1_mixed"), (None, 1 << 44, "sae"), (None, 1 << 58, "open")])
def test_security_kind(spark, text, bits, want):
    assert value(spark, S.security_kind(F.lit(text).cast("string"), F.lit(bits).cast("long"))) == want


def test_policy(spark):
    reason = lambda e, need, k, have: value(spark, S.policy_reason(F.lit(e).cast("string"), F.lit(need), F.lit(k), F.lit(have).cast("boolean")))
    assert reason("enterprise", False, "psk", None) == "not Enterprise"
    assert reason("wpa3", False, "enterprise", True) is None
    assert reason(None, True, "psk", False) == "MFP not required"
    assert reason("open_allowed", True, "open", None) is None
    assert reason("psk_or_better", False, "wep", None) == "weaker than WPA2-PSK"


def test_wilson_bounds(spark):
    for k, n in ((0, 10), (10, 10), (3, 7)):
        lo, hi = (value(spark, c) for c in S.wilson(F.lit(k), F.lit(n)))
        assert 0 <= lo <= k / n <= hi <= 1
    assert value(spark, S.wilson(F.lit(0), F.lit(0))[0]) is None


def test_stable_series_has_no_shifts_and_a_step_has(spark):
    rows = [(1, datetime(2024, 3, 1, 0, i), i, -50.0) for i in range(40)] + [(2, datetime(2024, 3, 1, 0, i), i, -50.0 if i < 20 else -65.0) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz, id int, v double")
    base = spark.createDataFrame([(1, -50.0, 1.0), (2, -50.0, 1.0)], "k int, median double, robust_sd double")
    found = detect.shifted_windows(df, ["k"], ["ts", "id"], "v", base, detect.ShiftRules())
    assert {r.k for r in found.select("k").collect()} == {2}
    e = detect.deviating_episodes(found, ["k"], "ts", "id", 300, 6, 900).first()
    assert (e.direction, e.peak) == ("weaker", -15.0)


def test_flood_is_high_and_lone_bursts_are_nothing(spark):
    flood = [("f", datetime(2024, 3, 1, 0, 0, i * 20 % 60), i, "burst") for i in range(3)] + [("f", datetime(2024, 3, 1, 0, i), 10 + i, "burst") for i in range(1, 9)]
    alerts = [("f", datetime(2024, 3, 1, 0, 2, s), 30 + s, "alert") for s in (0, 30)]
    df = spark.createDataFrame(flood + alerts + [("o", datetime(2024, 3, 1, 5), 1, "burst")], "s string, ts timestamp_ntz, id int, kind string")
    rates = spark.createDataFrame([("f", 0.5), ("o", 0.5)], "s string, per_hour double")
    got = {r.s: r.severity for r in detect.assessed_episodes(df, "s", "ts", "id", F.col("kind") == "alert", rates, detect.BurstRules()).collect()}
    assert got == {"f": "high", "o": None}


def test_windows_meet_rows_by_hour(spark):
    rows = spark.createDataFrame([(i, datetime(2024, 3, 1 + i % 20, i % 24)) for i in range(200)], "id int, ts timestamp_ntz")
    w = spark.createDataFrame([(datetime(2024, 3, d, 5), datetime(2024, 3, d, 9)) for d in range(1, 15)], "lo timestamp_ntz, hi timestamp_ntz")
    kept, counts = merge.outside_windows(rows, w, "ts", "lo", "hi")
    inside = lambda r: any(a <= r.ts < b for a, b in w.collect())
    every = rows.collect()
    assert sorted(r.id for r in kept.collect()) == sorted(r.id for r in every if not inside(r))
    assert sum(r.excluded for r in counts.collect()) == sum(map(inside, every)) > 0


def test_open_intervals(spark):
    d = lambda n: datetime(2024, 3, 1 + n)
    spans = [("a", d(0), d(3)), ("a", d(2), None), ("a", d(4), d(5)), ("a", d(9), None), ("b", d(0), d(2)), ("b", d(2), d(3)), ("c", d(5), d(4))]
    s = spark.createDataFrame([(i, *x) for i, x in enumerate(spans)], "sid int, k string, lo timestamp_ntz, hi timestamp_ntz")
    assert sorted((r.k, r.lo, r.hi, r.n) for r in intervals.merged(s.where("k <> 'c'"), ["k"], "lo", "hi").collect()) == [("a", d(0), None, 4), ("b", d(0), d(3), 2)]
    points = [(i, k, d(n)) for i, (k, n) in enumerate((k, n) for k in "abcd" for n in range(0, 12))]
    p = spark.createDataFrame(points, "pid int, k string, at timestamp_ntz")
    holds = lambda k, at, x: x[0] == k and x[1] <= at and (x[2] is None or at < x[2])
    got = sorted((r.pid, r.sid) for r in intervals.points_inside(p, s, ["k"], "at", "lo", "hi").collect())
    assert got == sorted((i, j) for i, k, at in points for j, x in enumerate(spans) if holds(k, at, x))
    out = sorted(r.pid for r in intervals.points_outside(p, s, ["k"], "at", "lo", "hi").collect())
    assert out == sorted(i for i, k, at in points if not any(holds(k, at, x) for x in spans))
    o = s.select("k", F.col("sid").alias("sid2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = sorted((r.sid, r.sid2) for r in intervals.overlapping(s, o, ["k"], ("lo", "hi"), ("lo2", "hi2")).collect())
    before = lambda a, b: b is None or a < b
    assert pairs == sorted((i, j) for i, x in enumerate(spans) for j, y in enumerate(spans) if x[0] == y[0] and before(x[1], y[2]) and before(y[1], x[2]))


@pytest.mark.parametrize("mean", [20.5, 300.0, 500.0, 1000.0, 25_000.0])
def test_poisson_threshold_of_large_means(spark, mean):
    import math

    x, tail, p = value(spark, S.poisson_threshold(F.lit(mean), 0.001, 3)), 0.0, 0.0
    logs = [-mean + i * math.log(mean) - math.lgamma(i + 1) for i in range(int(mean + 40 * mean**0.5) + 100)]
    tail = lambda y: sum(math.exp(v) for v in logs[y:])
    assert tail(x) < 0.001 <= tail(x - 1)


def test_strides_follow_the_search(spark):
    import math

    from tidemark.functions import decisions as D

    def stride(n):
        s = 4 if n >= 4 else 1
        while n % (n // s) == 0:
            if s >= n - 1:
                return 1
            s += 1
        return s

    rows = spark.range(1, 201).select("id", D.hop_stride(F.col("id")).alias("s")).withColumn("v", D.hop_visited(F.col("id"), F.lit(True), F.col("s"))).collect()
    assert {r.id: (r.s, r.v) for r in rows} == {n: (stride(n), n // math.gcd(n, stride(n))) for n in range(1, 201)}


def test_robust_spread(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 100)], "k string, v double")
    r = stats.robust_spread(df, ["k"], "v").first()
    assert (r["median"], round(r["robust_sd"], 4)) == (3.0, 1.4826)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k int, ts timestamp_ntz, id int, v double, flag boolean")
    assert series.episodes(df, ["k"], "ts", "id", 60).count() == 0
    assert series.sliding_median_mad(df, ["k"], ["ts", "id"], "v", 5).count() == 0
    assert rollup.hourly(df, "k", "ts", "v", F.col("flag")).count() == 0
    assert changes.validity(df, ["k"], "ts", "id", "v").count() == 0


def test_admissible_floor_share(spark):
    from tidemark.operators import audit

    def want(rows):
        lo, hi = 0.0, 0.5
        for f, bias, sd in sorted(rows, key=lambda r: r[0]):
            if bias is None or bias > max(sd or 0.0, 1.0):
                return lo, min(hi, f)
            lo = f
        return lo, hi

    for rows in ([(0.1, 0.5, 2.0), (0.2, 1.5, 2.0), (0.3, 2.5, 2.0), (0.4, 0.1, 2.0)], [(0.05, 0.2, None)], [(0.2, None, 1.0)], [(0.1, 0.9, 0.1), (0.6, 0.1, 1.0)]):
        df = spark.createDataFrame(rows, "f double, bias double, sd double")
        r = audit.admissible(df, "f", "bias", "sd").first()
        assert (r.lo, r.hi) == want(rows)


def test_thinned_heartbeats_follow_the_loop(spark):
    from tidemark import queries_names  # noqa: F401  registers
    from tidemark.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    by = {}
    for r in spark.read.parquet(f"{sf}/events.parquet").collect():
        by.setdefault(r.user_id, []).append((r.ts, r.event_id))
    want = set()
    for user, rows in by.items():  # a whole history: nothing starts afresh at midnight
        last = None
        for at, key in sorted(rows):
            if last is None or (at - last).total_seconds() >= 21600:
                want.add((user, key))
                last = at
    assert {(r.user_id, r.id) for r in QUERIES["st_heartbeat_thin"](spark, sf).collect()} == want


def test_censoring_bias(spark):
    from tidemark.functions import decisions as D

    def quantile(v, q):
        pos = q * (len(v) - 1)
        lo = int(pos)
        return v[lo] + (v[min(lo + 1, len(v) - 1)] - v[lo]) * (pos - lo)

    rows = [([-80.0, -70.0, -60.0, -50.0, -40.0], 0.2), ([-50.0], 0.1), ([], 0.1), ([-50.0, -40.0], 0.5)]
    got = [r.b for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, v array<double>, f double").orderBy("i").select(D.censoring_bias(F.col("v"), F.col("f")).alias("b")).collect()]
    want = [None if not v or f >= 0.5 else quantile(v, 0.5) - quantile(v, (0.5 - f) / (1 - f)) for v, f in rows]
    assert got == pytest.approx(want, nan_ok=True) if None not in want else [g is None for g in got] == [w is None for w in want] and [g for g in got if g is not None] == pytest.approx([w for w in want if w is not None])


def test_a_name_is_registered_once():
    from tidemark.queries import query

    with pytest.raises(ValueError):
        query("scan_table")(lambda t: None)
