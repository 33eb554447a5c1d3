"""Scalar functions as Column expressions; none needs Python in the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Readings that mean "at or below", never a level.
FLOOR_READINGS = (-106, -120)
# Bit positions of the security bitfield.
PROTECTED_BITS = (0, 1, 2, 3, 4, 7, 8, 23, 24, *range(37, 58))
WEP_BITS = (0, 7, 8, 23, 24)
TKIP_BITS = (9, 25)
PSK_BITS = (38, 40, 42, 55, 56)
SAE_BITS = (44, 45)
ENTERPRISE3_BITS = (47, 48, 49)
ENTERPRISE_BITS = (37, 39, 41, 50, 51, 52, 53)
OWE_BITS = (54,)
# How kinds of security are named and graded.
LABELS = {"open": "Open", "wep": "WEP", "wpa1_mixed": "WPA1/WPA2 mixed", "wpa1": "WPA1", "tkip": "WPA2 (TKIP)", "transition": "WPA2/WPA3 transition", "psk": "WPA2-PSK", "enterprise3": "WPA3-Enterprise", "enterprise": "WPA2-Enterprise", "sae": "WPA3-SAE", "owe": "OWE"}
RANKS = {"open": 0, "legacy": 1, "psk_no_mfp": 2, "strong": 3}
SEVERITIES = ("info", "low", "medium", "high", "critical")


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone (session zone UTC)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def choose(value: Column, table: dict, default=None) -> Column:
    """A CASE over constant keys."""
    out = None
    for k, v in table.items():
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return out.otherwise(F.lit(default))


def level_valid(reading: Column) -> Column:
    """The reading, or null where it is a floor."""
    return F.when(~reading.isin(*FLOOR_READINGS), reading)


def is_floor(reading: Column, flag: Column) -> Column:
    """A floor by value or by flag; unknown counts as no."""
    return F.coalesce(flag, F.lit(False)) | F.coalesce(reading.isin(*FLOOR_READINGS), F.lit(False))


def band_of_channel(channel: Column) -> Column:
    n = F.when(channel.rlike("^[0-9]{1,3}$"), channel.try_cast("int"))
    return F.when(n.between(1, 14), "2.4").when(n.between(32, 177), "5")


def band_of_freq(khz: Column) -> Column:
    return F.when(khz <= 0, None).when(khz < 3_000_000, "2.4").when(khz < 5_925_000, "5").when(khz.isNotNull(), "6")


def needs_dfs(channel: Column) -> Column:
    return F.coalesce(channel.between(52, 144), F.lit(False))


def has_bits(bits: Column, positions) -> Column:
    """Any of the bit positions is set."""
    return bits.bitwiseAND(F.lit(sum(1 << p for p in positions))) != 0


def security_kind(text: Column, bits: Column) -> Column:
    """The weakest kind of security on offer; from the text where the bitfield says nothing."""
    no_bits = bits.isNull() | ((bits == 0) & ~text.eqNullSafe(F.lit("Open")))
    psk, sae = text.contains("-PSK"), text.contains("-SAE")
    by_text = (
        F.when(text == "Open", "open").when(text.contains("WEP"), "wep").when(text.contains("WPA1"), "wpa1").when(text.contains("TKIP"), "tkip")
        .when(psk & sae, "transition").when(psk, "psk").when(text.contains("-EAP"), "enterprise").when(sae, "sae").otherwise("unknown")
    )
    by_bits = (
        F.when(~has_bits(bits, PROTECTED_BITS), "open").when(has_bits(bits, WEP_BITS), "wep")
        .when(has_bits(bits, (2,)) & has_bits(bits, (3,)), "wpa1_mixed").when(has_bits(bits, (2,)), "wpa1").when(has_bits(bits, TKIP_BITS), "tkip")
        .when(has_bits(bits, PSK_BITS) & has_bits(bits, SAE_BITS), "transition").when(has_bits(bits, PSK_BITS), "psk")
        .when(has_bits(bits, ENTERPRISE3_BITS), "enterprise3").when(has_bits(bits, ENTERPRISE_BITS), "enterprise")
        .when(has_bits(bits, SAE_BITS), "sae").when(has_bits(bits, OWE_BITS), "owe").otherwise("unknown")
    )
    return F.when(no_bits, by_text).otherwise(by_bits)


def security_level(kind: Column, required: Column) -> Column:
    """open, legacy, psk_no_mfp, strong or unknown, of a kind and whether frame protection is required."""
    psk = F.when(F.coalesce(required, F.lit(False)), "strong").otherwise("psk_no_mfp")
    return (
        F.when(kind == "open", "open").when(kind.isin("wep", "wpa1_mixed", "wpa1", "tkip"), "legacy").when(kind.isin("psk", "transition"), psk)
        .when(kind.isin("enterprise3", "enterprise", "sae", "owe"), "strong").otherwise("unknown")
    )


def security_label(kind: Column) -> Column:
    return choose(kind, LABELS, "Unknown")


def security_rank(level: Column) -> Column:
    return choose(level, RANKS)


def protection_state(supported: Column, required: Column) -> Column:
    return F.when(F.coalesce(required, F.lit(False)), "required").when(F.coalesce(supported, F.lit(False)), "capable").when(supported.isNotNull() | required.isNotNull(), "no")


def policy_reason(expected: Column, need: Column, kind: Column, required: Column) -> Column:
    """Null if a kind meets a policy, else the first reason why not."""
    have = F.coalesce(required, F.lit(False))
    missing = F.coalesce(need, F.lit(False)) & ~have
    company = kind.isin("enterprise", "enterprise3")
    return (
        F.when(expected.isNull() | (expected == "open_allowed"), F.when(missing & ~kind.isin("open", "unknown"), "MFP not required"))
        .when(kind == "unknown", "security unknown")
        .when((expected == "enterprise") & ~company, "not Enterprise")
        .when((expected == "psk_or_better") & ~(company | kind.isin("psk", "transition", "sae")), "weaker than WPA2-PSK")
        .when((expected == "wpa3") & ~((kind == "sae") | (company & have)), "not WPA3")
        .when(missing, "MFP not required")
    )


def alert_severity(level: Column) -> Column:
    return F.when(level >= 20, "critical").when(level >= 15, "high").when(level >= 10, "medium").when(level >= 5, "low").otherwise("info")


def raised(severity: Column, by: Column) -> Column:
    """A severity some steps up, at most the last; null stays null."""
    names = F.array(*map(F.lit, SEVERITIES))
    at = F.array_position(names, severity).cast("int")
    return F.when(severity.isNotNull(), F.element_at(names, F.least(at + by.cast("int"), F.lit(len(SEVERITIES)))))


def mac_normal(text: Column) -> Column:
    """AA:BB:CC:DD:EE:FF from twelve hex digits with any separators; null otherwise."""
    digits = F.upper(F.regexp_replace(text, "[^0-9A-Fa-f]", ""))
    return F.when(F.length(digits) == 12, F.regexp_replace(digits, "(..)(..)(..)(..)(..)(..)", "$1:$2:$3:$4:$5:$6"))


def mac_is_local(mac: Column) -> Column:
    """The locally administered bit of the first octet."""
    return F.conv(F.substring(mac, 1, 2), 16, 10).cast("int").bitwiseAND(F.lit(2)) != 0


def mac_vendor(mac: Column) -> Column:
    return F.substring(mac, 1, 8)


def mask_macs(text: Column) -> Column:
    """Every MAC in a text with its last three octets masked."""
    return F.regexp_replace(text, "(?i)\\b([0-9a-f]{2}(?::[0-9a-f]{2}){2})(?::[0-9a-f]{2}){3}\\b", "$1:xx:xx:xx")


def csv_safe(text: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    return F.when(text.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def plain_name(text: Column) -> Column:
    """Lower case, without anything but letters and digits."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def lookalike(a: Column, b: Column) -> Column:
    """Different names that are one edit apart, or equal, when made plain."""
    return (a != b) & (F.levenshtein(plain_name(a), plain_name(b)) <= 1)


def stable_hash(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))


def counter(text: Column) -> Column:
    """A whole number of at most 64 bits from text; absent or malformed counts as 0."""
    return F.coalesce(text.try_cast("long"), F.lit(0).cast("long"))


def duration_text(seconds: Column) -> Column:
    """1h 02m 03s, 2m 03s or 3s."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), two(m), F.lit("m "), two(r), F.lit("s"))).when(m > 0, F.concat(m.cast("string"), F.lit("m "), two(r), F.lit("s"))).otherwise(F.concat(r.cast("string"), F.lit("s")))


def cursor(at: Column, key: Column) -> Column:
    """A paging cursor: base64url of microseconds and key, without padding."""
    raw = F.concat_ws(".", at.cast("string"), key.cast("string"))
    return F.rtrim(F.translate(F.base64(raw.cast("binary")), "+/=", "-_ "))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval; null for no trials."""
    m = n.cast("double")
    p, zz = k / m, F.lit(z * z)
    centre = p + zz / (2 * m)
    half = z * F.sqrt(p * (1 - p) / m + zz / (4 * m * m))
    low, high = F.greatest(F.lit(0.0), (centre - half) / (1 + zz / m)), F.least(F.lit(1.0), (centre + half) / (1 + zz / m))
    return F.when(n > 0, low), F.when(n > 0, high)


def poisson_threshold(mean: Column, alpha: float, floor: int) -> Column:
    """The smallest count whose upper tail P(X >= x) is below alpha, at least `floor`; for any mean.

    The sum runs over counts within 12 deviations and 60 around the mean, in logarithms, so large means do not underflow;
    what lies below that is less than 1e-16.
    """
    reach = F.ceil(12 * F.sqrt(mean)).cast("long") + 60
    first = F.greatest(F.floor(mean).cast("long") - reach, F.lit(0).cast("long"))
    # ln(first!) by Stirling's series beyond 20, exactly below
    n = first.cast("double")
    exact = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(F.least(first, F.lit(20).cast("long")), F.lit(1).cast("long"))), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))
    stirling = n * F.log(n) - n + 0.5 * F.log(2 * 3.141592653589793 * n) + 1 / (12 * n) - 1 / (360 * n * n * n)
    start_p = F.exp(n * F.log(mean) - mean - F.when(first > 20, stirling).otherwise(exact))
    start = F.struct(start_p.alias("p"), start_p.alias("cdf"), first.alias("x"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * mean / i
        more = F.struct(p.alias("p"), (s["cdf"] + p).alias("cdf"), i.alias("x"))
        return F.when(s["cdf"] <= 1 - alpha, more).otherwise(s)

    found = F.aggregate(F.sequence(first + 1, F.floor(mean).cast("long") + reach), start, step, lambda s: s["x"] + 1)
    return F.when(mean <= 0, F.lit(floor).cast("long")).otherwise(F.greatest(F.lit(floor).cast("long"), found))
