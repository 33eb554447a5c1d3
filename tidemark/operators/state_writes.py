"""Writes of settings, configurations and upload states: stored rows and requests in, the new rows out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import micros
from tidemark.operators import halo

#: After how many refusals, or failed authentications, over how long, an upload counts as stalled.
REJECTS, AUTH_FAILS, PERSIST_S = 3, 3, 600


def applied(stored: DataFrame, requests: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """stored after requests (keys, fields, action: insert, update or delete; one a key): an insert of a known key and an update of an unknown one do nothing. keys, fields, changed."""
    s = stored.select(*keys, F.struct(*fields).alias("s"))
    r = requests.select(*keys, "action", F.struct(*fields).alias("r"))
    both = s.join(r, keys, "full")
    there, action = F.col("s").isNotNull(), F.coalesce("action", F.lit(""))
    new = F.when(there & (action == "update"), F.col("r")).when(~there & (action == "insert"), F.col("r")).otherwise(F.col("s"))
    left = both.where(new.isNotNull() & ~(there & (action == "delete"))).withColumn("n", new)
    return left.select(*keys, "n.*", (F.col("s").isNull() | ~F.col("n").eqNullSafe(F.col("s"))).alias("changed"))


def patched(stored: DataFrame, patches: DataFrame, keys: list[str], fields: list[str], keep_null: tuple[str, ...] = ()) -> DataFrame:
    """stored with the fields of patches (one a key) in place of its own, null included, but for keep_null, where null keeps what is stored."""
    p = patches.select(*keys, F.struct(*fields).alias("p"))
    out = stored.join(p, keys, "left")
    value = lambda f: F.coalesce(F.col(f"p.{f}"), F.col(f)) if f in keep_null else F.when(F.col("p").isNotNull(), F.col(f"p.{f}")).otherwise(F.col(f))
    return out.withColumns({f: value(f) for f in fields}).select(*stored.columns)


def versioned(stored: DataFrame, requests: DataFrame, key: str, order: str) -> DataFrame:
    """requests with their version: the next ones after the largest stored of each key, in order of request."""
    most = stored.groupBy(key).agg(F.max("version").alias("__v"))
    n = requests.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return n.join(most, key, "left").withColumn("version", F.coalesce("__v", F.lit(0)) + F.col("__n")).drop("__v", "__n")


def stall_transitions(events: DataFrame, unit: str = "day") -> DataFrame:
    """sensor, id, at, kind (upload_rejected, upload_unauthorized), since, count: the events with which a stall opens.

    events: sensor, id, at, what (accept, reject, auth_ok, auth_fail), seq. A run of refusals of one batch, or of failed
    authentications, that has REJECTS (AUTH_FAILS) of them and lasts PERSIST_S opens one; an accepted batch ends both runs, a
    good authentication the second. Runs are numbered by blocks of time.
    """

    def opened(own: str, ends: tuple[str, ...], least: int, kind: str, by_seq: bool) -> DataFrame:
        e = events.where(F.col("what").isin(own, *ends))
        key = F.concat_ws("/", "what", F.coalesce(F.col("seq").cast("string"), F.lit(""))) if by_seq else F.col("what")
        runs = halo.islands(e.withColumn("__key", F.when(F.col("what") == own, key)), ["sensor"], "at", "id", "__key", "run", unit).where(F.col("what") == own)
        w = Window.partitionBy("sensor", "run").orderBy("at", "id")
        first = F.min("at").over(w)
        at = runs.withColumns({"since": first, "count": F.row_number().over(w)})
        stalled = at.where((F.col("count") >= least) & (micros("at") - micros("since") >= PERSIST_S * 1_000_000))
        one = stalled.groupBy("sensor", "run").agg(F.min(F.struct("at", "id", "since", "count")).alias("x"))
        return one.select("sensor", "x.id", "x.at", F.lit(kind).alias("kind"), "x.since", "x.count")

    return opened("reject", ("accept",), REJECTS, "upload_rejected", True).union(opened("auth_fail", ("accept", "auth_ok"), AUTH_FAILS, "upload_unauthorized", False))


def upload_status(events: DataFrame) -> DataFrame:
    """sensor, last_contact_at, last_batch_at, last_batch_seq, contacts: the row that a sensor's uploads leave; only accepted ones are contact."""
    ok = F.col("what") == "accept"
    newest = F.max_by(F.when(ok, F.col("seq")), F.when(ok, F.struct("at", "id")))
    return events.groupBy("sensor").agg(F.max(F.when(ok, F.col("at"))).alias("last_contact_at"), F.max(F.when(ok & F.col("seq").isNotNull(), F.col("at"))).alias("last_batch_at"), newest.alias("last_batch_seq"), F.count_if(ok).alias("contacts"))


def extracted(polls: DataFrame, observations: DataFrame, devices: DataFrame, wanted: DataFrame) -> DataFrame:
    """poll, ts, found, rows: named polls with the rows of access points that they hold, as one JSON document each, for repairs. wanted: poll; a poll that is not there has found false."""
    known = observations.join(devices.where("is_ap").select("device"), "device", "left_semi")
    rows = known.join(wanted.select("poll").distinct(), "poll", "left_semi").groupBy("poll").agg(F.array_sort(F.collect_list(F.struct("id", "device", "level"))).alias("x"))  # the rows of one poll
    named = wanted.select("poll").distinct().join(polls, "poll", "left").join(rows, "poll", "left")
    return named.select("poll", "ts", F.col("ts").isNotNull().alias("found"), F.to_json(F.coalesce("x", F.array().cast("array<struct<id:bigint,device:bigint,level:bigint>>")), {"ignoreNullFields": "false"}).alias("rows"), F.coalesce(F.size("x"), F.lit(0)).alias("n"))


def probe_records(frames: DataFrame) -> DataFrame:
    """Probe requests as analysis records: id, mac, ts, level and is_floor (a floor reading is censored), local_mac, ssid_len, ie_keys, fp_order and fp_content (fingerprints by the order, and by the content, of the elements but for the name).

    frames: id, mac (text), ts, level, elements: key and value (binary) in order.
    """
    others = F.filter("elements", lambda e: ~e["key"].isin("0", "3"))
    name = F.get(F.filter("elements", lambda e: e["key"] == "0"), F.lit(0))
    digest = lambda parts: F.substring(F.sha2(F.array_join(parts, "|").cast("binary"), 256), 1, 16)
    local = F.conv(F.substring("mac", 1, 2), 16, 10).cast("int").bitwiseAND(2) > 0
    return frames.select(
        "id", "mac", "ts", F.when(F.col("level") > -100, F.col("level")).alias("level"), (F.col("level") <= -100).alias("is_floor"), local.alias("local_mac"), F.octet_length(name["value"]).alias("ssid_len"), F.array_join(F.transform("elements", lambda e: e["key"]), ",").alias("ie_keys"),
        digest(F.transform(others, lambda e: e["key"])).alias("fp_order"), digest(F.transform(others, lambda e: F.concat(e["key"], F.lit("="), F.hex(e["value"])))).alias("fp_content"),
    )
