"""Detectors over event series and readings, and their evaluation against trials."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import micros, poisson_threshold, raised
from tidemark.operators import intervals, series


@dataclass(frozen=True)
class BurstRules:
    """Fixed defaults of the burst detector."""

    gap_s: float = 300.0
    window_s: float = 600.0
    sustain_s: float = 10.0
    least_bursts: int = 3
    alpha: float = 0.001


@dataclass(frozen=True)
class ShiftRules:
    """Fixed defaults of the level-shift detector, in dB."""

    width: int = 10
    k: float = 3.0
    shift_floor: float = 8.0
    spread_k: float = 3.0
    spread_floor: float = 6.0
    sd_floor: float = 1.0


def counter_bursts(df: DataFrame, keys: list[str], ts: str, tie: str, counter: str, longest_s: float) -> DataFrame:
    """Rows whose counter has changed to another positive value since a row at most longest_s before."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    at = df.withColumns({"before": F.lag(counter).over(w), "since_s": (micros(ts) - F.lag(micros(ts)).over(w)) / 1e6})
    return at.where((F.col(counter) != F.col("before")) & (F.col(counter) > 0) & (F.col("since_s") <= longest_s))


def burst_severity(by_alert: Column, by_count: Column, alert_span_s: Column, sustain_s: float, worse: Column) -> Column:
    """High for both rules or a sustained alert, medium for the count rule or an alert of two seconds, low for a short one; a step up for worse cases."""
    level = (
        F.when(by_alert & by_count, "high").when(by_alert & (alert_span_s >= sustain_s), "high").when(by_alert & (alert_span_s >= 2), "medium").when(by_alert, "low").when(by_count, "medium")
    )
    return raised(level, F.coalesce(worse, F.lit(False)).cast("int"))


def assessed_episodes(events: DataFrame, subject: str, ts: str, tie: str, is_alert: Column, rates: DataFrame, rules: BurstRules, worse: Column | None = None, trusted: Column | None = None) -> DataFrame:
    """Episodes of bursts and alerts with their threshold, largest count in a window, rules and severity. rates: subject, per_hour. `worse` rows of a `trusted` subject raise their episode."""
    e = series.sessionize(events.withColumns({"__alert": is_alert, "__worse": F.lit(False) if worse is None else worse}), [subject], ts, tie, rules.gap_s)
    w = Window.partitionBy(subject, "episode").orderBy("__us").rangeBetween(-int(rules.window_s * 1e6), 0)
    e = e.withColumn("__us", micros(ts)).withColumn("__n", F.count(F.when(~F.col("__alert"), 1)).over(w))
    alert_at = F.when(F.col("__alert"), F.col("__us"))
    out = e.groupBy(subject, "episode").agg(
        F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), F.count_if("__alert").alias("alerts"), F.count_if(~F.col("__alert")).alias("bursts"),
        F.max("__n").alias("most_in_window"), F.max("__worse").alias("__worse"), ((F.max(alert_at) - F.min(alert_at)) / 1e6).alias("alert_span_s"),
    )
    # a rate has few values, so thresholds are worked out once for each
    each = rates.select("per_hour").distinct().withColumn("threshold", poisson_threshold(F.col("per_hour") * rules.window_s / 3600, rules.alpha, rules.least_bursts))
    known = rates.join(each, "per_hour").select(subject, "threshold")
    out = out.join(known, subject, "left").withColumn("threshold", F.coalesce("threshold", F.lit(rules.least_bursts)))
    rule_a, rule_b = F.col("alerts") > 0, F.col("most_in_window") >= F.col("threshold")
    span = F.coalesce("alert_span_s", F.lit(0.0))
    return out.withColumns({"rule_a": rule_a, "rule_b": rule_b, "severity": burst_severity(rule_a, rule_b, span, rules.sustain_s, F.col("__worse") & (F.lit(True) if trusted is None else trusted))}).drop("__worse")


def shifted_windows(df: DataFrame, keys: list[str], order: list[str], value: str, base: DataFrame, rules: ShiftRules) -> DataFrame:
    """Trailing windows that leave their baseline, with dev and facet. base: keys, median, robust_sd."""
    return deviating(series.sliding_median_mad(df, keys, order, value, rules.width), keys, base, rules)


def deviating(windows: DataFrame, keys: list[str], base: DataFrame, rules: ShiftRules) -> DataFrame:
    """The windows (win_median, win_mad) that leave their baseline, with dev and facet."""
    at = windows.where("win_median is not null").join(base.select(*keys, "median", "robust_sd"), keys)
    sigma = F.greatest("robust_sd", F.lit(rules.sd_floor))
    dev = F.col("win_median") - F.col("median")
    shift = F.abs(dev) >= F.greatest(sigma * rules.k, F.lit(rules.shift_floor))
    spread = F.col("win_mad") >= F.greatest(sigma * rules.spread_k, F.lit(rules.spread_floor))
    facet = F.when(shift & spread, "both").when(shift, "median_shift").when(spread, "spread_inflation")
    return at.withColumns({"dev": dev, "facet": facet}).where("facet is not null")


def eligibility(base: DataFrame, n_obs: str, n_floor: str, excluded: Column, most_floor: float) -> DataFrame:
    """base with reason: why an entity is not watched; null if it is."""
    share = F.try_divide(F.col(n_floor), F.col(n_obs) + F.col(n_floor))
    return base.withColumn("reason", F.when(excluded, "random_bssid").when(share > most_floor, "floor_share"))


def outside_guard(found: DataFrame, changes: DataFrame, keys: list[str], ts: str, at: str, guard_s: int) -> DataFrame:
    """What was found further than guard_s from every change of its entity."""
    span = changes.select(*keys, (F.col(at) - F.expr(f"interval {guard_s} seconds")).alias("__lo"), (F.col(at) + F.expr(f"interval {guard_s} seconds 1 microsecond")).alias("__hi"))
    return intervals.points_outside(found, span, keys, ts, "__lo", "__hi")


def deviating_episodes(found: DataFrame, keys: list[str], ts: str, tie: str, gap_s: float, least: int, span_s: float) -> DataFrame:
    """Episodes of deviating windows that persist: at least `least` within span_s; with the largest deviation and its direction."""
    e = series.sessionize(found, keys, ts, tie, gap_s).withColumn("__us", micros(ts))
    w = Window.partitionBy(*keys, "episode").orderBy("__us").rangeBetween(-int(span_s * 1e6), 0)
    e = e.withColumn("__n", F.count("*").over(w))
    peak = F.max_by("dev", F.struct(F.abs("dev"), F.col("__us"), F.col(tie)))
    out = e.groupBy(*keys, "episode").agg(F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), F.count("*").alias("n"), F.max("__n").alias("most"), peak.alias("peak"))
    return out.where(F.col("most") >= least).withColumn("direction", F.when(F.col("peak") >= 0, "stronger").otherwise("weaker")).drop("most")


def matched_trials(trials: DataFrame, detections: DataFrame, subject: str, before_s: int, after_s: int) -> DataFrame:
    """trials with the best detection of their subject that touches [start - before, stop + after]: worst severity, then earliest."""
    wide = trials.select(subject, "trial_id", "start_at", (F.col("start_at") - F.expr(f"interval {before_s} seconds")).alias("__lo"), (F.col("stop_at") + F.expr(f"interval {after_s} seconds 1 microsecond")).alias("__hi"))
    d = detections.select(subject, F.col("ts").alias("__ts"), (F.col("ts_end") + F.expr("interval 1 microsecond")).alias("__end"), "severity_rank", "detection_id")
    both = intervals.overlapping(wide, d, [subject], ("__lo", "__hi"), ("__ts", "__end"))
    found = F.struct("detection_id", "severity_rank", ((micros("__ts") - micros("start_at")) / 1e6).alias("latency_s"))
    # the least of (severity falling, time, id); severity ranks are small numbers
    best = both.groupBy("trial_id").agg(F.min_by(found, F.struct(-F.coalesce("severity_rank", F.lit(-1)), "__ts", "detection_id")).alias("x")).select("trial_id", "x.*")
    return trials.join(best, "trial_id", "left")


def refreshed_findings(stored: DataFrame, found: DataFrame, keys: list[str], gap_s: int) -> DataFrame:
    """found with action (insert, refresh) and the stored finding it continues: the earliest of equal keys whose span, widened by the gap, it touches. An operator's label stays with the stored one."""
    gap, tick = F.expr(f"interval {gap_s} seconds"), F.expr("interval 1 microsecond")
    s = stored.select(*keys, F.col("id").alias("stored_id"), "label", (F.col("ts") - gap).alias("__lo"), (F.col("ts_end") + gap + tick).alias("__hi"))
    n = found.select(*keys, "id", F.col("ts").alias("__ts"), (F.col("ts_end") + tick).alias("__end"))
    near = intervals.overlapping(n, s, keys, ("__ts", "__end"), ("__lo", "__hi"))
    first = near.groupBy("id").agg(F.min_by(F.struct("stored_id", "label"), F.struct("__lo", "stored_id")).alias("x")).select("id", "x.*")
    both = found.select("id").join(first, "id", "left")
    return both.select("id", F.when(F.col("stored_id").isNotNull(), "refresh").otherwise("insert").alias("action"), "stored_id", "label")
