"""Decision functions and helpers of the domain as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalars import choose

# The shortest shift of a clock that counts, and days kept in hand before retention ends.
MIN_SHIFT_S, RETENTION_MARGIN_DAYS = 10, 2
# What the bits of the security bitfield are called, by group.
DETAIL = {
    "general": {0: "WEP", 1: "WPA", 2: "WPA1", 3: "WPA2", 4: "WPA3"},
    "group": {7: "WEP40", 8: "WEP104", 9: "TKIP", 10: "CCMP", 11: "BIP-CMAC-128", 12: "GCMP-128", 13: "GCMP-256", 14: "CCMP-256", 15: "BIP-GMAC-128", 16: "BIP-GMAC-256", 17: "BIP-CMAC-256", 18: "OCB"},
    "pairwise": {23: "WEP40", 24: "WEP104", 25: "TKIP", 26: "CCMP", 27: "BIP-CMAC-128", 28: "GCMP-128", 29: "GCMP-256", 30: "CCMP-256", 31: "BIP-GMAC-128", 32: "BIP-GMAC-256", 33: "BIP-CMAC-256", 34: "OCB"},
    "akm": {37: "802.1X", 38: "PSK", 39: "802.1X-FT", 40: "PSK-FT", 41: "802.1X-SHA256", 42: "PSK-SHA256", 43: "TDLS", 44: "SAE", 45: "SAE-FT", 46: "AP-PEER", 47: "802.1X-SUITE-B", 48: "802.1X-SUITE-B-192", 49: "802.1X-FT-SHA384", 50: "FILS-SHA256", 51: "FILS-SHA384", 52: "FILS-SHA256-FT", 53: "FILS-SHA384-FT", 54: "OWE", 55: "PSK-FT-SHA384", 56: "PSK-SHA384", 57: "WPS"},
    "eap": {58: "LEAP", 59: "TLS", 60: "TTLS", 61: "PEAP", 62: "IDENTITY"},
}
# Seconds of the units of durations.
UNITS = {"": 1, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def security_detail(bits: Column, group: str) -> Column:
    """The names of a group's set bits, in order of the bits."""
    names = F.array(*(F.when(bits.bitwiseAND(F.lit(1 << at)) != 0, name) for at, name in DETAIL[group].items()))
    return F.array_compact(names)


def is_ap_evidence(*signs: Column) -> Column:
    """Any sign that a device is an access point; unknown counts as none."""
    return F.greatest(*(F.coalesce(s, F.lit(False)) for s in signs))


def ap_class(manual: Column, kind: Column, allowed: Column, vendor_allowed: Column, has_list: Column, random: Column, typical: Column, by_vendor: bool, suspicious_unallowed: bool, ignore_random: bool, weakest: float) -> Column:
    """The class of an access point: set by hand, else by its network's list, else by its address and level."""
    unlisted = F.when(has_list & F.lit(suspicious_unallowed), "suspicious").otherwise("unknown")
    managed = F.when(allowed, "managed").when(vendor_allowed, "managed" if by_vendor else "unknown").otherwise(unlisted)
    by_network = F.when(kind == "managed", managed).when(kind.isNotNull(), "friendly")
    by_itself = F.when(random & F.lit(ignore_random), "ignored").when(typical < weakest, "ignored")
    return F.coalesce(manual, by_network, by_itself, F.lit("unknown"))


def ap_is_mobile(random: Column, vendor: Column, first: Column, last: Column, latest: Column, vendors: tuple[str, ...]) -> Column:
    """A random address, a vendor of mobile devices, or a life of less than two hours that is over."""
    by_vendor = F.lit(False)
    for v in vendors:
        by_vendor = by_vendor | F.coalesce(F.lower(vendor).startswith(v.lower()), F.lit(False))
    short = (last < first + F.expr("interval 2 hours")) & (last < latest - F.expr("interval 1 hour"))
    return F.coalesce(random, F.lit(False)) | by_vendor | F.coalesce(short, F.lit(False))


def key_mac(key: Column) -> Column:
    """The address in a device key: the last twelve hex digits, in pairs, last pair first."""
    pairs = F.reverse(F.array(*(F.substring(F.substring_index(key, "_", -1), 2 * i + 1, 2) for i in range(6))))
    return F.when(key.rlike("_[0-9A-Fa-f]{12}$"), F.upper(F.array_join(pairs, ":")))


def gcd(a: Column, b: Column) -> Column:
    """The greatest common divisor of numbers from 1; Euclid's steps, of which 64 bits need fewer than 94."""
    start = F.struct(a.cast("long").alias("x"), b.cast("long").alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.pmod(s["x"], F.when(s["y"] == 0, F.lit(1).cast("long")).otherwise(s["y"])).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(94)), start, step, lambda s: s["x"])


def hop_stride(n: Column) -> Column:
    """The stride with which a list of n channels is hopped: the first from 4 on (1 for shorter lists) that n // (n // s) does not divide evenly; 1 if there is none below n - 1.

    A stride up to the root of n is even only if it divides n, and no 64-bit number is divided by all from 4 to 64; so longer
    lists than 4,096 are settled by the first 64 strides.
    """
    begin = F.when(n < 4, 1).otherwise(4)
    even = lambda s: F.pmod(n, F.greatest(F.floor(n / s), F.lit(1))) == 0
    tried = F.filter(F.sequence(begin.cast("long"), F.greatest(F.least(n.cast("long") - 2, F.when(n < 4_096, 4_096).otherwise(64)), begin.cast("long"))), lambda s: ~even(s))
    last = F.greatest(n.cast("long") - 1, begin.cast("long"))
    return F.coalesce(F.get(tried, F.lit(0)), F.when(~even(last), last).otherwise(F.lit(1).cast("long")))


def hop_visited(n: Column, shuffled: Column, stride: Column) -> Column:
    """How many entries of a hop list are tuned at all."""
    return F.when((n > 0) & shuffled & (stride > 0), F.floor(n / gcd(n, F.greatest(stride, F.lit(1))))).otherwise(n).cast("long")


def hop_ok(running: Column, n: Column, visited: Column, live: Column, configured: Column) -> Column:
    """Whether the live list is the configured one, in any order, and all of it is visited; null without a configured list."""
    return F.when(configured.isNotNull(), F.coalesce(running, F.lit(False)) & (visited == n) & (F.array_sort(live) == F.array_sort(configured)))


def poll_fate(synced: Column, anchored: Column, same_boot: Column) -> Column:
    """SEND, HOLD until the anchor comes, or UNVERIFIED."""
    return F.when(F.coalesce(synced, F.lit(True)) | F.coalesce(anchored, F.lit(False)), "SEND").when(same_boot, "HOLD").otherwise("UNVERIFIED")


def placed_frame(value: Column, epoch_true: Column, epoch_stale: Column, step_mono: Column) -> Column:
    """A frame time written under a stale clock, shifted by the clock's error, if that is MIN_SHIFT_S or more."""
    delta = epoch_true - epoch_stale
    stale = step_mono.isNull() | (value < epoch_stale + step_mono)
    return F.when((delta >= MIN_SHIFT_S) & stale, value + delta).otherwise(value)


def placeable(value: Column, lo: Column, hi: Column, delta: Column) -> Column:
    """A device-level time inside a stale window (lo, hi; null: in none): shifted by a delta of MIN_SHIFT_S or more, unchanged for a smaller one, null where the delta is unknown or far negative."""
    inside = F.coalesce(value.between(lo, hi), F.lit(False))
    return F.when(~inside, value).when(delta >= MIN_SHIFT_S, F.round(value + delta).cast("long")).when(F.abs(delta) < MIN_SHIFT_S, value)


def adapter_action(stored_id: Column, stored_mac: Column, new_id: Column, new_mac: Column) -> Column:
    """none, fill or change: what a reported adapter does to the stored one."""
    known = lambda x: F.coalesce(x, F.lit("")) != ""
    differs = lambda old, new: F.coalesce(F.lower(old) != F.lower(new), F.lit(False))
    fills = lambda old, new: old.isNull() & new.isNotNull()
    return (
        F.when(~known(new_id) & ~known(new_mac), "none").when(stored_id.isNull() & stored_mac.isNull(), "fill")
        .when(differs(stored_id, new_id) | differs(stored_mac, new_mac), "change").when(fills(stored_id, new_id) | fills(stored_mac, new_mac), "fill").otherwise("none")
    )


def retention_risk(oldest: Column, days: Column, backlog: Column, now: Column, newest_stored: Column) -> Column:
    """The oldest unsent row (unix seconds) is about to be dropped, and is not stored already."""
    late = oldest < now - (days - RETENTION_MARGIN_DAYS) * 86400
    known = F.coalesce(oldest <= newest_stored, F.lit(False))
    return F.coalesce((days > 0) & (backlog > 0) & late & ~known, F.lit(False))


def delivered(version: Column, sha: Column, refused: Column, confirmed: Column, accepting: Column, applied: Column) -> Column:
    """The version of a configuration that is to be sent, or null."""
    due = F.coalesce(accepting, F.lit(False)) & sha.isNotNull() & refused.isNull() & confirmed.isNull() & ~applied.eqNullSafe(sha)
    return F.when(due, version)


def attempt_actions(known: Column, result: Column, effective: Column, started: Column, restored: Column) -> Column:
    """What a reported attempt at a configuration does, in order."""
    none = F.array().cast("array<string>")
    names = lambda *x: F.array(*map(F.lit, x))
    applied = F.when(effective.isNotNull(), names("confirm", "boundary", "close_events")).otherwise(none)
    window = F.when(started.isNotNull() & restored.isNotNull(), names("coverage")).otherwise(none)
    rest = F.when(result == "applied", applied).when(result == "rolled_back", F.concat(names("refuse"), window, names("open_event"))).when(result == "failed", names("refuse", "open_event")).when(result.isin("refused", "invalid"), names("refuse")).otherwise(none)
    return F.concat(names("attempt"), F.when(F.coalesce(known, F.lit(False)), F.concat(names("delivered"), rest)).otherwise(none))


def parse_duration(text: Column) -> Column:
    """Seconds of 7d, 36h, 90m, 45s or 600; null for anything else."""
    shape = r"^\s*(\d+(?:\.\d+)?)\s*([smhdwSMHDW]?)\s*$"
    unit = choose(F.lower(F.regexp_extract(text, shape, 2)), UNITS)
    return F.when(text.rlike(shape), F.regexp_extract(text, shape, 1).try_cast("double") * unit)


def parse_when(text: Column) -> Column:
    """A date or date-time of ISO 8601, UTC where it names no zone; null for anything else."""
    shape = r"^\s*\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|z|[+-]\d{2}:?\d{2})?)?\s*$"
    return F.when(text.rlike(shape), F.try_to_timestamp(F.upper(F.trim(text))))


def _hundredths(x: Column) -> Column:
    """x to two decimals as text, rounded by its binary value: halves that are exact go to the even digit."""
    low = F.floor(x * 100)
    head = F.floor(x * (1 << 26)) / (1 << 26)  # 200 * head, less the half's 2 * low + 1, and 200 * the rest are exact, so the sign of their sum is
    over = (head * 200 - (low * 2 + 1)) + (x - head) * 200
    n = low + ((over > 0) | ((over == 0) & (low % 2 == 1))).cast("int")
    return F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))


def compact_duration(seconds: Column) -> Column:
    """0.01s, 45s, 3m10s, 2h05m, 1d03h; - for null."""
    s = F.rint(seconds).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    m, h, d = F.floor(s / 60), F.floor(s / 3600), F.floor(s / 86400)
    text = lambda *x: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in x))
    return (
        F.when(seconds.isNull(), "-").when(seconds < 10, text(_hundredths(seconds), "s")).when(s < 60, text(s.cast("string"), "s")).when(m < 60, text(m.cast("string"), "m", two(s % 60), "s"))
        .when(h < 24, text(h.cast("string"), "h", two(m % 60), "m")).otherwise(text(d.cast("string"), "d", two(h % 24), "h"))
    )


def canonical_sha256(**fields: Column) -> Column:
    """The digest of a document with its keys in order and nothing between its tokens."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields)))).cast("binary"), 256)


def censoring_bias(values: Column, share: Column) -> Column:
    """How far leaving out a share of lowest, censored readings has moved the median of the rest (sorted values); null from a half on."""

    def at(q: Column) -> Column:
        pos = q * (F.size(values) - 1)
        lo = F.floor(pos).cast("int")
        hi = F.least(lo + 1, F.size(values) - 1)
        low = F.get(values, lo)
        return low + (F.get(values, hi) - low) * (pos - lo)

    return F.when((F.size(values) > 0) & (share < 0.5), at(F.lit(0.5)) - at((0.5 - share) / (1 - share)))


def presence_label(hours: Column, day_hours: Column, days: Column, of_hours: Column) -> Column:
    """permanent, daytime, transient or intermittent, of the hours and days that an entity was seen."""
    return F.when(hours >= 0.9 * of_hours, "permanent").when((day_hours >= 0.8 * hours) & (days >= 3), "daytime").when(hours <= 2, "transient").otherwise("intermittent")


def clients_source(stations: Column, util: Column, counted: Column) -> Column:
    """Which counter a number of clients comes from: the access point's own, or the sensor's."""
    return F.when((F.coalesce(stations, F.lit(0)) > 0) | (F.coalesce(util, F.lit(0)) > 0), "ap").when(counted.isNotNull(), "sensor")


def grade_unknown(vendor_known: Column, kind_matches: Column, close: Column, corroborated: Column) -> Column:
    """The severity of an unknown member of a network; a step up for each of close and corroborated."""
    from tidemark.functions.scalars import raised

    return raised(F.when(vendor_known & kind_matches, "low").otherwise("medium"), close.cast("int") + corroborated.cast("int"))


def grade_shift(most_db: Column, stronger: Column, trusted: Column, corroborated: Column, high_db: float, medium_db: float) -> Column:
    """The severity of a level shift by its size; a step up for a stronger signal of a trusted point, and for corroboration."""
    from tidemark.functions.scalars import raised

    level = F.when(most_db >= high_db, "high").when(most_db >= medium_db, "medium").otherwise("low")
    return raised(level, (stronger & trusted).cast("int") + corroborated.cast("int"))
