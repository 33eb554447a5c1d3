"""What is wrong with a record that is sent in: the first rule that it breaks, in words; null if it may be stored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.decisions import gcd, hop_stride

# What records may hold.
CHANNEL = r"^[0-9]{1,3}(HT40[+-]|VHT80|VHT160)?$"
NO_PAIRING = ("165HT40-", "140HT40-")
DWELLS = (0.2, 0.5, 1.0)
POLLS = (15, 30, 60)
EXPECTED = ("enterprise", "psk_or_better", "wpa3", "open_allowed")
CLASSES = ("managed", "friendly", "unknown", "suspicious", "ignored")
GUARDS = (0, 600, 1800, 3600)
MAC = r"^[0-9A-Fa-f]{2}(:[0-9A-Fa-f]{2}){5}$"
USB_ID = r"^[0-9a-f]{4}:[0-9a-f]{4}$"
UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
MIN_S, FUTURE_S = 1_788_220_800, 300


def first_broken(*rules: tuple[Column, str]) -> Column:
    """The words of the first rule whose condition holds."""
    out = F.when(F.coalesce(rules[0][0], F.lit(False)), rules[0][1])
    for broken, words in rules[1:]:
        out = out.when(F.coalesce(broken, F.lit(False)), words)
    return out


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def heartbeat(h: dict[str, Column]) -> Column:
    """h: sensor_ts, offset_s (numbers), boot_id, usb_id, mac, version (texts), adapter_text (any other text of the adapter)."""
    return first_broken(
        (~_finite(h["sensor_ts"]), "heartbeat: sensor_ts is invalid"), (~_finite(h["offset_s"]), "heartbeat: chrony_offset_s is invalid"), (~h["boot_id"].rlike(UUID), "heartbeat: boot_id is invalid"),
        (F.char_length(h["version"]) > 200, "heartbeat: buffer_version is invalid"), (h["sensor_ts"].isNull(), "heartbeat: sensor_ts is required"), (F.char_length(h["adapter_text"]) > 64, "heartbeat: adapter.driver is invalid"),
        (~h["usb_id"].rlike(USB_ID), "heartbeat: adapter.usb_id must be vid:pid in lower-case hex"), (~h["mac"].rlike(MAC), "heartbeat: adapter.mac must be a MAC address"),
    )


def boots(items: Column, most: int | None = 16) -> Column:
    """items: at most 16 (most; None: any number) of boot_id, source, epoch_true, polls_corrected; the first entry that breaks a rule decides."""
    one = lambda b: first_broken(
        (b["source"].isNull() | ~b["source"].isin("ntp", "server") | b["epoch_true"].isNull() | ~_finite(b["epoch_true"]), "boots: boot_id, source ntp|server and epoch_true are required"),
        (b["boot_id"].isNull() | ~b["boot_id"].rlike(UUID), "boots: boot_id is invalid"), (b["polls_corrected"] < 0, "boots: polls_corrected must be a count"),
    )
    found = F.filter(F.transform(items, one), lambda x: x.isNotNull())
    first = F.get(found, F.lit(0))
    return first if most is None else F.when(F.size(items) > most, f"boots: a list of at most {most} expected").otherwise(first)


def gaps(items: Column, most: int | None = 100) -> Column:
    """items: at most 100 (most; None: any number) of seq_from, seq_to, reason."""
    broken = lambda g: F.coalesce((g["seq_from"] < 1) | (g["seq_to"] < g["seq_from"]) | ~g["reason"].isin("lost", "unverified"), F.lit(True))
    wrong = F.when(F.exists(items, broken), "gaps: seq_from <= seq_to and reason lost|unverified required")
    return wrong if most is None else F.when(F.size(items) > most, f"gaps: a list of at most {most} expected").otherwise(wrong)


def row_time(seconds: Column, now_s: Column) -> Column:
    """A row's time in unix seconds."""
    return first_broken((seconds.isNull(), "ts is required"), (~_finite(seconds), "ts must be unix seconds"), (seconds < MIN_S, "ts is before 2026-09-01"), (seconds > now_s + FUTURE_S, "ts is in the future (the sensor's clock?)"))


def octets(text: Column, n: int) -> Column:
    """n octets in any of the usual spellings as upper-case pairs with colons; null if they are not n octets."""
    plain = F.upper(F.regexp_replace(F.trim(text), "[:-]", ""))
    fits = F.trim(text).rlike(r"^[0-9A-Fa-f]{2}([:-]?[0-9A-Fa-f]{2})*$") & (F.char_length(plain) == 2 * n)
    return F.when(fits, F.array_join(F.array(*(F.substring(plain, 2 * i + 1, 2) for i in range(n))), ":"))


def network(ssid: Column, kind: Column, expected: Column, allowed_bssids: Column, allowed_ouis: Column, note: Column) -> Column:
    """A managed or friendly network; only a managed one has a policy to check."""
    bad = lambda a, n: F.exists(a, lambda x: octets(x, n).isNull())
    return first_broken(
        (ssid.isNull() | (F.trim(ssid) == "") | (F.octet_length(ssid) > 32), "ssid: 1 to 32 bytes"), (kind.isNull() | ~kind.isin("managed", "friendly"), "kind: managed or friendly"),
        ((kind == "managed") & expected.isNotNull() & ~expected.isin(*EXPECTED), "expected_security: " + ", ".join(EXPECTED)), (F.size(allowed_bssids) + F.size(allowed_ouis) > 200, "allowed_bssids / allowed_ouis: lists, together at most 200"),
        (bad(allowed_bssids, 6), "bssid: not a MAC address of 6 octets"), (bad(allowed_ouis, 3), "oui: not a MAC address of 3 octets"), (F.char_length(note) > 500, "note: at most 500 characters"),
    )


def detectors(s: dict[str, Column]) -> Column:
    """An account's detector settings: deauth_min_bursts, deauth_window_s, evil_twin_k, evil_twin_min_db, evil_twin_guard_s, sensor_offline_min."""
    bounds = {"deauth_min_bursts": (1, 100), "deauth_window_s": (30, 86_400), "evil_twin_k": (1, 50), "evil_twin_min_db": (1, 60), "evil_twin_guard_s": (0, 3_600), "sensor_offline_min": (1, 1_440)}
    kind = lambda c: "a number" if c in ("evil_twin_k", "evil_twin_min_db") else "a whole number"
    rules = [(s[c].isNull() | ~s[c].between(lo, hi), f"{c}: {kind(c)} {lo} to {hi}") for c, (lo, hi) in bounds.items()]
    return first_broken(*rules, (~s["evil_twin_guard_s"].isin(*GUARDS), "evil_twin_guard_s: one of " + ", ".join(map(str, GUARDS))))


def capture_config(channels: Column, dwell_s: Column, poll_s: Column, supported: Column) -> Column:
    """A hop list: entries once each, known pairings, supported ones (if the adapter said which), of a length that its stride visits whole; dwell and poll times on offer."""
    plain = F.transform(channels, lambda c: F.upper(F.trim(c)))
    n = F.size(channels)
    missing = F.array_except(plain, F.transform(supported, lambda c: F.upper(F.trim(c))))
    return first_broken(
        (channels.isNull() | ~n.between(1, 200), "channels: 1 to 200 entries"), (F.exists(plain, lambda c: c.isNull() | ~c.rlike(CHANNEL)), "channels: not a Kismet entry"), (F.size(F.array_distinct(plain)) < n, "channels: an entry twice"),
        (F.exists(plain, lambda c: c.isin(*NO_PAIRING)), "channels: not a valid 40 MHz pairing"), ((F.size(supported) > 0) & (F.size(missing) > 0), "channels: not supported by the adapter"),
        (gcd(n, hop_stride(n)) != 1, "channels: the length must be coprime with the stride"), (dwell_s.isNull() | ~dwell_s.isin(*DWELLS), "dwell_s: one of 0.2, 0.5, 1.0"), (poll_s.isNull() | ~poll_s.isin(*POLLS), "poll_s: one of 15, 30, 60"),
    )


def label(ids: Column, classification: Column, note: Column) -> Column:
    """A write of labels or notes: 1 to 500 positive ids, a class or null, a note of at most 2000 characters."""
    return first_broken(
        (ids.isNull() | ~F.size(ids).between(1, 500), "ids: 1 to 500 event ids"), (F.exists(ids, lambda i: i.isNull() | (i <= 0)), "ids: positive integers"),
        (classification.isNotNull() & ~classification.isin(*CLASSES), "classification: " + ", ".join(CLASSES) + " or null"), (F.char_length(note) > 2_000, "note: at most 2000 characters"),
    )
