"""How much of a time was covered by capture: by bucket, over a window, by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import micros

_HOUR = 3_600_000_000


def shared_s(a_lo, a_hi, b_lo, b_hi) -> Column:
    """Seconds that two spans share."""
    return F.greatest((F.least(micros(a_hi), micros(b_hi)) - F.greatest(micros(a_lo), micros(b_lo))) / 1e6, F.lit(0.0))


def hour_capture(hours: DataFrame, spans: DataFrame, poll_s: int = 30) -> DataFrame:
    """hours (sensor, hour, polls, capture, limited, gap_s) with capture_s: seconds of the hour inside the sensor's span (first_poll, last_poll) without gaps, in the share of capturing polls."""
    h = hours.join(spans, "sensor")
    lo = F.greatest(micros("hour"), micros("first_poll"))
    hi = F.least(micros("hour") + _HOUR, micros("last_poll") + poll_s * 1_000_000)
    seconds = F.greatest((hi - lo) / 1e6 - F.col("gap_s"), F.lit(0.0)) * F.col("capture") / F.col("polls")
    return h.withColumn("capture_s", F.when(F.col("polls") > 0, seconds).otherwise(0.0))


def by_bucket(captured: DataFrame, bucket: Column, seconds: float) -> DataFrame:
    """sensor, bucket, share: capture seconds over the bucket's seconds, at most 1."""
    out = captured.withColumn("bucket", bucket).where("bucket is not null").groupBy("sensor", "bucket").agg(F.sum("capture_s").alias("__s"))
    return out.select("sensor", "bucket", F.round(F.least(F.lit(1.0), F.col("__s") / seconds), 3).alias("share"))


def window_share(captured: DataFrame, excluded: DataFrame, lo, hi) -> DataFrame:
    """sensor, share: capture seconds of [lo, hi) over its seconds outside of the excluded spans (lo, hi; disjoint; null: open); null if nothing is left."""
    ex = excluded.groupBy("sensor").agg(F.sum(shared_s(F.col("lo"), F.coalesce("hi", hi), lo, hi)).alias("__ex"))
    c = captured.groupBy("sensor").agg(F.sum(F.when((F.col("hour") >= lo) & (F.col("hour") < hi), F.col("capture_s"))).alias("__s"))
    left = (micros(hi) - micros(lo)) / 1e6 - F.coalesce("__ex", F.lit(0.0))
    return c.join(ex, "sensor", "left").select("sensor", F.when(left > 0, F.round(F.least(F.lit(1.0), F.coalesce("__s", F.lit(0.0)) / left), 3)).alias("share"))


def by_day(captured: DataFrame, spans: DataFrame, days: DataFrame, excluded: DataFrame, limited_notes: DataFrame, now, poll_s: int = 30) -> DataFrame:
    """sensor, day and the shares of it that were ok, limited, outage, excluded, not_installed, no_data.

    days: day, lo, hi; spans: sensor, first_poll, last_poll; excluded and limited_notes: sensor, lo, hi (null: open). The pairs of
    days with spans are as many as sensors have days; excluded spans and notes are met by day.
    """
    d = days.withColumn("hi", F.least("hi", now)).where("lo < hi")
    grid = spans.join(F.broadcast(d)).select("sensor", "first_poll", (F.col("last_poll") + F.expr(f"interval {poll_s} seconds")).alias("data_end"), "day", "lo", "hi")
    note = limited_notes.select("sensor", F.col("lo").alias("n_lo"), F.coalesce("hi", now).alias("n_hi"))
    note = note.where("n_lo < n_hi").withColumn("hour", F.explode(F.sequence(F.date_trunc("hour", "n_lo"), F.date_trunc("hour", "n_hi"), F.expr("interval 1 hour"))))
    noted = note.withColumn("hour", F.col("hour").cast("timestamp_ntz")).groupBy("sensor", "hour").agg(F.least(F.lit(3600.0), F.sum(shared_s(F.col("n_lo"), F.col("n_hi"), F.col("hour"), F.col("hour") + F.expr("interval 1 hour")))).alias("noted_s"))
    c = captured.join(noted, ["sensor", "hour"], "left")
    part = F.greatest(F.col("limited") / F.col("capture"), F.coalesce("noted_s", F.lit(0.0)) / 3600)
    c = c.where("capture > 0").withColumn("lim_s", F.col("capture_s") * part).withColumn("day", F.to_date("hour"))
    c = c.groupBy("sensor", "day").agg(F.sum("capture_s").alias("cap"), F.sum("lim_s").alias("lim"))
    ex = excluded.select("sensor", F.col("lo").alias("e_lo"), F.coalesce("hi", now).alias("e_hi")).where("e_lo < e_hi")
    ex = ex.withColumn("day", F.explode(F.sequence(F.to_date("e_lo"), F.to_date("e_hi"))))
    g = grid.join(ex, ["sensor", "day"], "left")
    begin = F.greatest("lo", "first_poll")
    there = F.col("e_lo").isNotNull()
    inside = F.when(there & (F.col("data_end") > begin), shared_s(F.col("e_lo"), F.col("e_hi"), begin, F.least("hi", "data_end"))).otherwise(0.0)
    later = F.greatest(begin, F.col("data_end"))
    after = F.when(there & (F.col("hi") > later), shared_s(F.col("e_lo"), F.col("e_hi"), later, F.col("hi"))).otherwise(0.0)
    g = g.groupBy("sensor", "day", "lo", "hi", "first_poll", "data_end").agg(F.sum(F.coalesce(inside, F.lit(0.0))).alias("ex_data"), F.sum(F.coalesce(after, F.lit(0.0))).alias("ex_after"))
    g = g.join(c, ["sensor", "day"], "left").na.fill(0.0, ["cap", "lim"])
    total = (micros("hi") - micros("lo")) / 1e6
    share = lambda s, name: F.round(s / total, 3).alias(name)
    zero = F.lit(0.0)
    return g.select(
        "sensor", "day", share(F.col("cap") - F.col("lim"), "ok"), share(F.col("lim"), "limited"),
        share(F.greatest(shared_s("lo", "hi", "first_poll", "data_end") - F.col("cap") - F.col("ex_data"), zero), "outage"), share(shared_s("lo", "hi", "lo", "first_poll"), "not_installed"),
        share(F.greatest(shared_s("lo", "hi", "data_end", "hi") - F.col("ex_after"), zero), "no_data"), share(F.col("ex_data") + F.col("ex_after"), "excluded"),
    )
