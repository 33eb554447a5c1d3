"""The twin detector as one run: level shifts of known access points (b) and strangers under an established name (a).

Readings are passed over once, dealt by access point and day with the rows before a day as its halo (operators.halo), so
neither an access point's history nor its deviations come together in one task. The two signals corroborate each other
where both are there at the same time; findings carry their evidence as JSON.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import decisions as D
from tidemark.functions.scalars import micros
from tidemark.operators import audit, detect, halo, intervals, series
from tidemark.operators.stats import quantile
from tidemark.session import kept


@dataclass(frozen=True)
class TwinRules:
    """Fixed defaults of the twin detector; levels in dBm, deviations in dB."""

    gap_s: int = 300
    shift: detect.ShiftRules = detect.ShiftRules(k=6.0)
    persistence: int = 6
    persist_window_s: float = 900
    med_dev: float = 12.0
    high_dev: float = 20.0
    persist_hours: float = 1.0
    persist_obs: int = 20
    most_floor: float = 0.35
    guard_s: int = 0
    close_dbm: float = -60.0
    strong_db: float = 10.0


def _widened(lo: str, hi: str, s: int) -> tuple[Column, Column]:
    return F.col(lo) - F.expr(f"interval {s} seconds"), F.col(hi) + F.expr(f"interval {s} seconds 1 microsecond")


def watched(base: DataFrame, aps: DataFrame, rules: TwinRules) -> DataFrame:
    """base (ap, median, robust_sd, n_obs, n_floor) with reason: why an access point is not compared; null if it is. A random address counts unless a sibling has a fixed one."""
    b = base.join(aps.select("ap", "random", "sibling"), "ap")
    return detect.eligibility(b, "n_obs", "n_floor", F.col("random") & ~F.col("sibling"), rules.most_floor).drop("random", "sibling")


def shift_episodes(readings: DataFrame, base: DataFrame, changes: DataFrame | None, rules: TwinRules) -> DataFrame:
    """Episodes of deviating windows that persist: ap, episode, first_at, last_at, n_windows, most, peak (signed), spread_mad, facet, direction. readings: id, ap, ts, level, all comparable with the baseline."""
    near = halo.with_rows_before(kept(readings, "compared"), ["ap"], "ts", "id", rules.shift.width - 1)
    windows = halo.inside(series.sliding_median_mad(near, ["ap", halo.BLOCK], ["ts", "id"], "level", rules.shift.width))
    found = detect.deviating(windows, ["ap"], base, rules.shift).select("ap", "id", "ts", "dev", "win_mad", "facet")
    if changes is not None and rules.guard_s > 0:
        found = detect.outside_guard(found, changes, ["ap"], "ts", "at", rules.guard_s)
    e = kept(halo.sessionized(kept(found, "shifts"), ["ap"], "ts", "id", rules.gap_s), "shift-episodes")
    most = halo.most_in_span(e, ["ap", "episode"], "ts", rules.persist_window_s)
    shift, spread = (F.max(F.col("facet").isin("both", f)) for f in ("median_shift", "spread_inflation"))
    facet = F.when(shift & spread, "both").when(shift, "median_shift").otherwise("spread_inflation")
    peak = F.min_by("dev", F.struct(-F.abs("dev"), F.col("ts"), F.col("id")))
    out = e.groupBy("ap", "episode").agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count("*").alias("n_windows"), peak.alias("peak"), F.max("win_mad").alias("spread_mad"), facet.alias("facet"))
    return out.join(most, ["ap", "episode"]).where(F.col("most") >= rules.persistence).withColumn("direction", F.when(F.col("peak") > 0, "stronger").otherwise("weaker"))


def strangers(readings: DataFrame, aps: DataFrame, advertised: DataFrame, alerts: DataFrame, rules: TwinRules) -> DataFrame:
    """Access points that advertise an established name without being trusted: network, ap, win_first, win_last, win_obs, span_s, win_median, group_median, vendor_known, kind_matches, dominant, sustained, close, alert_ids.

    A name is established if a trusted access point has advertised it. advertised: ap, network, past names included.
    """
    seen = readings.groupBy("ap").agg(F.count("level").alias("win_obs"), F.min("ts").alias("win_first"), F.max("ts").alias("win_last"), quantile("level", 0.5).alias("win_median"))
    every = advertised.distinct().join(aps.drop("network"), "ap").join(seen, "ap", "left")
    known = every.where("trusted")
    groups = known.groupBy("network").agg(quantile("win_median", 0.5).alias("group_median"))
    kinds = known.where("kind is not null").groupBy("network", "kind").agg(F.count("*").alias("n")).groupBy("network").agg(F.min_by("kind", F.struct(-F.col("n"), "kind")).alias("dominant"))
    vendors = known.select("network", "vendor").distinct().withColumn("vendor_known", F.lit(True))
    ids = alerts.groupBy("ap").agg(F.array_sort(F.collect_list("alert_id")).alias("alert_ids"))
    u = every.where(~F.col("trusted") & (F.col("win_obs") > 0)).join(groups, "network").join(kinds, "network", "left").join(vendors, ["network", "vendor"], "left").join(ids, "ap", "left")
    span = (micros("win_last") - micros("win_first")) / 1e6
    sustained = ~F.col("random") & ((span >= rules.persist_hours * 3600) | (F.col("win_obs") >= rules.persist_obs))
    close = F.coalesce((F.col("win_median") >= rules.close_dbm) | F.coalesce(F.col("win_median") >= F.col("group_median") + rules.strong_db, F.lit(False)), F.lit(False))
    return u.select(
        "network", "ap", "win_first", "win_last", "win_obs", span.alias("span_s"), "win_median", "group_median", F.coalesce("vendor_known", F.lit(False)).alias("vendor_known"),
        F.coalesce(F.col("kind") == F.col("dominant"), F.lit(False)).alias("kind_matches"), "dominant", sustained.alias("sustained"), close.alias("close"), F.coalesce("alert_ids", F.array().cast("array<bigint>")).alias("alert_ids"),
    )


def members(aps: DataFrame, advertised: DataFrame) -> DataFrame:
    """network, trusted_aps: the trusted access points that advertise a name, one row a network."""
    known = advertised.distinct().join(aps.where("trusted").select("ap"), "ap", "left_semi")
    return known.groupBy("network").agg(F.array_sort(F.collect_set("ap")).alias("trusted_aps"))


def _times(spans: DataFrame, lo: str, hi: str) -> DataFrame:
    """The times that a network's intervals cover, as intervals apart from each other: first those of a day's begins, then all."""
    by_day = intervals.merged(spans.withColumn("__day", F.to_date(lo)), ["network", "__day"], lo, hi)
    return intervals.merged(by_day.select("network", lo, hi), ["network"], lo, hi).drop("n")


def evidence_of_shift(rules: TwinRules) -> Column:
    """What a shift's finding shows: rules, place, baseline, what was observed and the thresholds."""
    return F.to_json(F.struct(
        F.lit("b").alias("signal"), F.struct(F.lit(True).alias("rssi_deviation"), F.col("corroborated").alias("unknown_bssid")).alias("rules"), F.struct("ap", "network", "trusted").alias("ap"),
        F.struct(F.round("median", 2).alias("median"), F.round("robust_sd", 2).alias("robust_sd"), "n_obs").alias("baseline"),
        F.struct("facet", "direction", F.round(F.abs("peak"), 2).alias("max_dev_db"), F.round(F.abs("peak") / F.greatest("robust_sd", F.lit(rules.shift.sd_floor)), 2).alias("k_sigma"), F.round("spread_mad", 2).alias("spread_mad"), "n_windows", "most").alias("observed"),
        F.struct(F.lit(rules.shift.k).alias("k"), F.lit(rules.shift.shift_floor).alias("floor_db"), F.lit(rules.persistence).alias("persistence"), F.lit(rules.shift.width).alias("width")).alias("threshold"),
    ))


def evidence_of_stranger() -> Column:
    """What a stranger's finding shows: rules, place, the trusted set it is not part of, and what was observed."""
    return F.to_json(F.struct(
        F.lit("a").alias("signal"), F.struct(F.col("corroborated").alias("rssi_deviation"), F.lit(True).alias("unknown_bssid")).alias("rules"), F.struct("ap", "network").alias("ap"),
        F.struct("trusted_aps", "dominant", "vendor_known", "kind_matches", "alert_ids", "win_obs", F.round("span_s", 3).alias("span_s"), "sustained").alias("membership"),
        F.struct(F.round("win_median", 2).alias("win_median"), F.round("group_median", 2).alias("group_median"), "close").alias("observed"),
    ))


def twin_run(readings: DataFrame, base: DataFrame, aps: DataFrame, advertised: DataFrame, hardware: DataFrame, changes: DataFrame, alerts: DataFrame, since: datetime, until: datetime, rules: TwinRules) -> tuple[DataFrame, DataFrame]:
    """Findings (signal, ap, network, ts, ts_end, severity, evidence) of [since, until), and what was looked at: one row of counts.

    readings: id, ap, ts, level; base: ap, median, robust_sd, n_obs, n_floor; aps: ap, network, vendor, kind, random, sibling,
    trusted; hardware: ap, hw_from, hw_to of the baseline; changes: ap, at; alerts: ap, alert_id.
    """
    gap = timedelta(seconds=rules.gap_s)
    moment = lambda x: F.lit(x.isoformat()).cast("timestamp_ntz")
    scan = readings.where((F.col("ts") >= moment(since - gap)) & (F.col("ts") < moment(until + gap)))
    w = kept(watched(base, aps, rules), "watched")
    ok = w.where("reason is null").select("ap", "median", "robust_sd", "n_obs")
    levels = audit.in_hardware_period(scan.where("level is not null").join(ok.select("ap"), "ap", "left_semi"), hardware)
    e = shift_episodes(levels.where("same").drop("same"), ok, changes, rules).where((F.col("last_at") >= moment(since)) & (F.col("first_at") < moment(until)))
    e = kept(e.join(aps.select("ap", "network", "trusted"), "ap").join(ok, "ap"), "episodes")
    u = kept(strangers(scan, aps, advertised, alerts, rules), "strangers")

    # trusted access points' episodes and strangers that will be reported, under one name at about the same time
    names = advertised.join(aps.where("trusted").select("ap"), "ap", "left_semi").select("ap", "network").distinct()
    lo, hi = _widened("win_first", "win_last", rules.gap_s)
    x = u.where("sustained").select("network", F.col("ap").alias("u_ap"), lo.alias("u_lo"), hi.alias("u_hi"))
    y = e.join(names, ["ap", "network"], "left_semi").select("network", F.col("ap").alias("e_ap"), "episode", F.col("first_at").alias("e_lo"), (F.col("last_at") + F.expr("interval 1 microsecond")).alias("e_hi"))
    # which of one side meet any of the other is asked of the times that the other covers, so no pairs of the two arise
    of_e = intervals.overlapping(_times(x, "u_lo", "u_hi"), y, ["network"], ("u_lo", "u_hi"), ("e_lo", "e_hi"))
    of_u = intervals.overlapping(x, _times(y, "e_lo", "e_hi"), ["network"], ("u_lo", "u_hi"), ("e_lo", "e_hi"))
    yes = F.lit(True).alias("corroborated")
    sure = lambda df: df.withColumn("corroborated", F.coalesce("corroborated", F.lit(False)))
    e = sure(e.join(of_e.select(F.col("e_ap").alias("ap"), "episode", yes).distinct(), ["ap", "episode"], "left"))
    u = sure(u.join(of_u.select(F.col("u_ap").alias("ap"), "network", yes).distinct(), ["ap", "network"], "left"))

    severity_b = D.grade_shift(F.abs("peak"), F.col("direction") == "stronger", F.col("trusted"), F.col("corroborated"), rules.high_dev, rules.med_dev)
    severity_a = D.grade_unknown(F.col("vendor_known"), F.col("kind_matches"), F.col("close"), F.col("corroborated"))
    found = e.select(F.lit("b").alias("signal"), "ap", "network", F.col("first_at").alias("ts"), F.col("last_at").alias("ts_end"), severity_b.alias("severity"), evidence_of_shift(rules).alias("evidence")).unionByName(
        u.where("sustained").join(members(aps, advertised), "network", "left").select(F.lit("a").alias("signal"), "ap", "network", F.col("win_first").alias("ts"), F.col("win_last").alias("ts_end"), severity_a.alias("severity"), evidence_of_stranger().alias("evidence"))
    )
    info = w.agg(F.count("*").alias("baselined"), F.count_if(F.col("reason") == "random_bssid").alias("random_bssid"), F.count_if(F.col("reason") == "floor_share").alias("floor_share"))
    other = levels.agg(F.count_if(~F.col("same")).alias("other_hardware"), F.count_distinct(F.when(F.col("same"), F.col("ap"))).alias("scanned"))
    return found, info.join(F.broadcast(other)).join(F.broadcast(u.agg(F.count("*").alias("candidates"))))


def pass_in_order(df: DataFrame, keys: list[str], ts: str, tie: str, fields: list[str], unit: str = "day") -> DataFrame:
    """df's rows numbered as a reader that goes through each entity once would see them, with the fields of the row before: by block, numbers added up over blocks."""
    near = halo.with_rows_before(df, keys, ts, tie, 1, unit)
    w = Window.partitionBy(*keys, halo.BLOCK).orderBy(ts, tie)
    before = {f"before_{c}": F.lag(c).over(w) for c in fields}
    own = halo.inside(near.withColumns(before))
    n = own.groupBy(*keys, halo.BLOCK).agg(F.count("*").alias("__n"))
    start = n.withColumn("__n", F.sum("__n").over(Window.partitionBy(*keys).orderBy(halo.BLOCK)) - F.col("__n"))
    return own.withColumn("place", F.row_number().over(w)).join(start, [*keys, halo.BLOCK]).withColumn("place", F.col("place") + F.col("__n")).drop("__n", halo.BLOCK)
