"""Dashboard reads: feeds, heat maps, attention lists, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import micros


def attention(events: DataFrame, rank: str, ts: str, key: str, least: int, limit: int) -> DataFrame:
    """The newest events at or above a rank, worst first, with the number of all such events."""
    some = events.where(F.col(rank) >= least)
    total = some.agg(F.count("*").alias("total"))
    return some.orderBy(F.desc(rank), F.desc(ts), F.desc(key)).limit(limit).crossJoin(F.broadcast(total))


def events_per_bucket(events: DataFrame, bucket: Column, rank: str, key: str, k: int) -> DataFrame:
    """bucket, n, worst: the number of events and the k worst (keys, comma-joined)."""
    b = events.withColumn("bucket", bucket)
    w = Window.partitionBy("bucket").orderBy(F.desc(rank), key)
    top = b.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("__n", key))).alias("__top"))
    n = b.groupBy("bucket").agg(F.count("*").alias("n"))
    return n.join(top, "bucket").select("bucket", "n", F.array_join(F.transform("__top", lambda x: x[key].cast("string")), ",").alias("worst"))


def feed(events: DataFrame, grouped: Column, keys: list[str], ts: str, key: str) -> DataFrame:
    """Feed rows: minor events folded by keys and day, others alone; placed at the newest, with members."""
    row = F.when(grouped, F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.to_date(ts).cast("string"))).otherwise(F.concat(F.lit("#"), F.col(key).cast("string")))
    return events.withColumn("row_key", row).groupBy("row_key").agg(F.max(ts).alias("newest"), F.max(key).alias("newest_id"), F.count("*").alias("members"), F.min(ts).alias("oldest"))


def heat_map(events: DataFrame, ts: str, zone: str, value: Column) -> DataFrame:
    """day, hour, value in local time; an hour that a clock change doubles keeps its larger value."""
    local = F.from_utc_timestamp(F.col(ts).cast("timestamp"), zone)
    per_hour = events.groupBy(F.date_trunc("hour", F.col(ts).cast("timestamp")).alias("__u")).agg(value.alias("value"))
    local = F.from_utc_timestamp("__u", zone)
    return per_hour.groupBy(F.to_date(local).alias("day"), F.hour(local).alias("hour")).agg(F.max("value").alias("value"))


def sensor_status(seen_s: Column, upload_s: Column, backlog: Column, capturing: Column) -> Column:
    """A sensor's state by seconds since it was last heard and last uploaded."""
    return (
        F.when(seen_s.isNull(), "unknown").when(seen_s > 600, "offline").when(backlog > 10, "catching_up").when(upload_s > 600, "unreachable")
        .when(~capturing, "not_capturing").otherwise("online")
    )


def transitions(df: DataFrame, keys: list[str], ts: str, tie: str, condition: Column) -> DataFrame:
    """keys, at, change: where a condition starts and where it resolves."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    c = df.withColumn("__c", F.coalesce(condition, F.lit(False))).withColumn("__was", F.coalesce(F.lag("__c").over(w), F.lit(False)))
    return c.where("__c <> __was").select(*keys, F.col(ts).alias("at"), F.when(F.col("__c"), "start").otherwise("resolve").alias("change"))


def daily_availability(gaps: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """keys, day, available: the share of each day that no gap covers, of days that gaps reach into."""
    days = gaps.select("*", F.explode(F.sequence(F.to_date(start), F.to_date(end))).alias("day"))
    day_us = micros(F.col("day").cast("timestamp"))
    lost = F.greatest(F.least(micros(end), day_us + 86_400_000_000) - F.greatest(micros(start), day_us), F.lit(0)) / 1e6
    return days.groupBy(*keys, "day").agg((1 - F.sum(lost) / 86400).alias("available"))


def heat_grid(hours: DataFrame, captured: DataFrame, load: DataFrame, zone: str) -> DataFrame:
    """day, hour (local), state, value: a cell for each hour of each local day of `hours` (hour): ok with its value, no_data without capture, load_missing without load, outside for hours of the days that are not asked for. Of a doubled hour the larger value stays."""
    local = F.from_utc_timestamp(F.col("hour").cast("timestamp"), zone)
    h = hours.join(captured.select("hour", F.lit(True).alias("__c")), "hour", "left").join(load.select("hour", F.col("value").alias("__v")), "hour", "left")
    state = F.when(F.col("__c").isNull(), "no_data").when(F.col("__v").isNull(), "load_missing").otherwise("ok")
    cells = h.select(F.to_date(local).alias("day"), F.hour(local).alias("at"), state.alias("state"), F.when(state == "ok", F.col("__v")).alias("value"))
    best = cells.groupBy("day", "at").agg(F.max_by(F.struct("state", "value"), F.struct((F.col("state") == "ok").cast("int"), F.coalesce("value", F.lit(-1)))).alias("x"))
    grid = cells.select("day").distinct().select("day", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("at"))
    out = grid.join(best, ["day", "at"], "left")
    return out.select("day", F.col("at").alias("hour"), F.coalesce("x.state", F.lit("outside")).alias("state"), F.col("x.value").alias("value"))


def contact_status(silent_s: Column, capture_s: Column, held: Column, backlog: Column, discarding: Column, limit_s: int, most_backlog: int) -> Column:
    """A sensor's state from its contact; without any contact from its last capture alone."""
    capturing = F.coalesce(capture_s <= limit_s, F.lit(False))
    return (
        F.when(silent_s.isNull(), F.when(capturing, "online").otherwise("offline")).when(silent_s > limit_s, "unreachable").when(held > 0, "clock_unverified").when(backlog > most_backlog, "catching_up")
        .when(discarding, "discarding").when(~capturing, "not_capturing").otherwise("online")
    )


def alarms(sensors: DataFrame, limit_s: int, least_free: float) -> DataFrame:
    """sensor, alarm: contact, capture or disk for each sensor where it is on. Rows: sensor, silent_s, capture_s, discarding, free."""
    contact = F.coalesce(F.col("silent_s") > limit_s, F.lit(True))
    capture = ~contact & ~F.col("discarding") & F.coalesce(F.col("capture_s") > limit_s, F.lit(True))
    on = F.array_compact(F.array(F.when(contact, "contact"), F.when(capture, "capture"), F.when(F.col("free") < least_free, "disk")))
    return sensors.select("sensor", F.explode(on).alias("alarm"))


def ramp(peak: Column, shares: tuple[float, ...]) -> Column:
    """Thresholds at shares of a peak, rounded to two significant digits of it and strictly increasing."""
    step = F.pow(F.lit(10.0), F.greatest(F.lit(0.0), F.floor(F.log10(peak)) - 1))
    top = F.ceil(peak / step) * step

    def more(out: Column, share: Column) -> Column:
        last = F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0.0))
        return F.concat(out, F.array(F.greatest(F.floor(top * share / step + 0.5) * step, last + step)))

    return F.when(peak > 0, F.aggregate(F.array(*map(F.lit, shares)), F.array().cast("array<double>"), more))
