"""The status of an account, the cards of its sensors and the page of an access point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import micros
from tidemark.operators import halo


def status(events: DataFrame, bssids: DataFrame, networks: DataFrame) -> DataFrame:
    """part, name, n, failing, not_assessed, reason: open events by severity and in all, and for each managed network how many of its access points meet the policy.

    events: severity of open ones; bssids: network, reason (null: meets it), unassessed; networks: network. The reason shown is
    the most frequent one, ties the smaller.
    """
    no = F.lit(None).cast("long")
    by = events.groupBy(F.col("severity").alias("name")).agg(F.count("*").alias("n")).select(F.lit("severity").alias("part"), "name", "n")
    every = events.agg(F.count("*").alias("n")).select(F.lit("open").alias("part"), F.lit("all").alias("name"), "n")
    open_ = by.union(every).select("part", "name", "n", no.alias("failing"), no.alias("not_assessed"), F.lit(None).cast("string").alias("reason"))
    known = ~F.col("unassessed")
    fails = known & F.col("reason").isNotNull()
    counts = bssids.groupBy("network").agg(F.count_if(known).alias("n"), F.count_if(fails).alias("failing"), F.count_if("unassessed").alias("not_assessed"))
    reasons = bssids.where(fails).groupBy("network", "reason").agg(F.count("*").alias("c")).groupBy("network").agg(F.min_by("reason", F.struct(-F.col("c"), "reason")).alias("reason"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    nets = networks.join(counts, "network", "left").join(reasons, "network", "left").select(F.lit("network").alias("part"), F.col("network").alias("name"), zero("n"), zero("failing"), zero("not_assessed"), "reason")
    return open_.union(nets)


def recoveries(alerts: DataFrame, unit: str = "day") -> DataFrame:
    """sensor, at, first_error: each re-opening of a source with the first error since the one before (null: a restart). alerts: sensor, id, at, is_open (else an error)."""
    w = Window.partitionBy("sensor", halo.BLOCK).orderBy("at", "id")
    new = F.coalesce(F.lag("is_open").over(w), F.lit(False)).cast("long")
    runs = halo.numbered(halo.inside(halo.with_rows_before(alerts, ["sensor"], "at", "id", 1, unit).withColumn("__new", new)), ["sensor"], ["at", "id"], "run")
    out = runs.groupBy("sensor", "run").agg(F.max(F.when(F.col("is_open"), F.col("at"))).alias("at"), F.min(F.when(~F.col("is_open"), F.col("at"))).alias("first_error"))
    return out.where("at is not null").drop("run")


def crashes(alerts: DataFrame, last_poll: DataFrame, hours: int = 24) -> DataFrame:
    """sensor, crashes, restarts, within_60s, max_recovery_s in the hours before each sensor's last poll."""
    inside = (F.col("at") > F.col("last_poll") - F.expr(f"interval {hours} hours")) & (F.col("at") <= F.col("last_poll"))
    r = recoveries(alerts).join(F.broadcast(last_poll), "sensor").where(inside).withColumn("s", (micros("at") - micros("first_error")) / 1e6)
    return r.groupBy("sensor").agg(F.count("first_error").alias("crashes"), F.count_if(F.col("first_error").isNull()).alias("restarts"), F.count_if(F.col("s") <= 60).alias("within_60s"), F.max(F.floor("s")).cast("long").alias("max_recovery_s"))


def cadence(polls: DataFrame, last: int = 120) -> DataFrame:
    """sensor, poll_s: the middle one of the last spacings between polls."""
    newest = Window.partitionBy("sensor").orderBy(F.desc("ts"), F.desc("id"))
    recent = polls.select("sensor", "id", "ts").withColumn("n", F.row_number().over(newest)).where(F.col("n") <= last + 1)
    step = recent.withColumn("s", (micros("ts") - micros(F.lead("ts").over(newest))) / 1e6).where("s is not null")
    return step.groupBy("sensor").agg(F.expr("percentile_disc(0.5) within group (order by s)").alias("poll_s"))


def configurations(configs: DataFrame) -> DataFrame:
    """sensor, config_version, pending_version, refused: the newest confirmed configuration, and the newest one after it that is not. configs: sensor, version, confirmed, refused."""
    done = configs.where("confirmed").groupBy("sensor").agg(F.max("version").alias("config_version"))
    later = configs.where("not confirmed").join(F.broadcast(done), "sensor", "left").where(F.col("version") > F.coalesce("config_version", F.lit(0)))
    pending = later.groupBy("sensor").agg(F.max(F.struct("version", "refused")).alias("p")).select("sensor", F.col("p.version").alias("pending_version"), F.col("p.refused").alias("refused"))
    return configs.select("sensor").distinct().join(done, "sensor", "left").join(pending, "sensor", "left")


def heard(readings: DataFrame, last_poll: DataFrame, days: int = 7) -> DataFrame:
    """sensor, aps_7d, only_here_7d: access points heard in the days before each sensor's last poll, and those that no other sensor heard then."""
    window = F.col("last_poll") - F.expr(f"interval {days} days")
    latest = readings.groupBy("sensor", "ap").agg(F.max("ts").alias("last"))
    two = latest.groupBy("ap").agg(F.max(F.struct("last", "sensor")).alias("a"), F.collect_list(F.struct("last", "sensor")).alias("every"))  # one entry a sensor
    other = F.array_max(F.transform(F.filter("every", lambda x: x["sensor"] != F.col("sensor")), lambda x: x["last"]))
    each = latest.join(two, "ap").join(F.broadcast(last_poll), "sensor").where(F.col("last") >= window).withColumn("elsewhere", other)
    alone = F.col("elsewhere").isNull() | (F.col("elsewhere") < window)
    return each.groupBy("sensor").agg(F.count("*").alias("aps_7d"), F.count_if(alone).alias("only_here_7d"))


def ap_page(sensors: DataFrame, history: DataFrame, events: DataFrame, most: tuple[int, int] = (200, 100)) -> DataFrame:
    """ap, part, at, text: an access point's page: its sensors, its latest configuration changes and its latest events, as texts. sensors: ap, at, text; history: ap, at, text; events: ap, id, at, text."""

    def latest(df: DataFrame, tie: Column, n: int) -> DataFrame:
        w = Window.partitionBy("ap").orderBy(F.desc("at"), tie)
        return df.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n)

    part = lambda df, name: df.select("ap", F.lit(name).alias("part"), "at", "text")
    return part(sensors, "sensor").union(part(latest(history, F.col("text"), most[0]), "change")).union(part(latest(events, F.desc("id"), most[1]), "event"))
