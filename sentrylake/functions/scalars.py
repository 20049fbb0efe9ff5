"""Small scalar expressions shared by sources, detectors and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentrylake.functions.net import bind
from sentrylake.schema import SEVERITIES

# IP protocol numbers that some firmware logs instead of names.
PROTOCOL_NAMES = {
    "1": "icmp", "2": "igmp", "6": "tcp", "17": "udp",
    "47": "gre", "50": "esp", "58": "icmpv6", "89": "ospf",
}

# Syslog levels.
SYSLOG_LEVELS = ("emerg", "alert", "crit", "err", "warning", "notice", "info", "debug")

# Indicator tiers and what they weigh.
TIER_SEVERITY = {"T1": "CRITICAL", "T2": "HIGH", "T3": "MEDIUM", "T4": "LOW"}
TIER_CONFIDENCE = {"T1": 0.9, "T2": 0.7, "T3": 0.5, "T4": 0.2}

# Firewall actions that stopped the packet.
BLOCKING_ACTIONS = ("drop", "reject", "deny", "block")

# Parts of the local day, six hours each from midnight.
DAYPARTS = ("night", "morning", "afternoon", "evening")


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def lookup(key: Column, table: dict) -> Column:
    """Value of ``key`` in a short fixed table, null when absent."""
    pairs = iter(table.items())
    k, v = next(pairs)
    out = F.when(key == k, F.lit(v))
    for k, v in pairs:
        out = out.when(key == k, F.lit(v))
    return out


def dedup_key(source: Column | str, *parts: Column) -> Column:
    """Stable identity of a record: source name and 20 digits of a SHA-1 over its parts."""
    name = F.lit(source) if isinstance(source, str) else source
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.concat(name, F.lit(":"), F.substring(F.sha1(F.concat_ws("|", name, *texts)), 1, 20))


def normalize_protocol(proto: Column | str) -> Column:
    """Protocol name in lower case, numbers translated, empty text as null."""

    def name(text: Column) -> Column:
        return F.when(text != "", F.coalesce(lookup(text, PROTOCOL_NAMES), text))

    return bind(F.lower(_c(proto)), name)


def syslog_severity(level: Column | str) -> Column:
    """Name of a syslog level; other numbers stay as text, names are lower-cased."""
    text = _c(level).cast("string")
    names = {str(i): name for i, name in enumerate(SYSLOG_LEVELS)}
    return F.coalesce(lookup(F.regexp_replace(text, "^0+(?=[0-9])", ""), names), F.lower(text))


def parse_severity(value: Column | str) -> Column:
    """Severity rank from a name or an integer (clamped to 0..4); null when it is neither."""
    text = F.upper(F.trim(_c(value).cast("string")))
    number = F.greatest(F.lit(0), F.least(F.lit(4), text.try_cast("int")))
    return F.coalesce(lookup(text, SEVERITIES), number)


def severity_label(rank: Column | str) -> Column:
    """Name of a severity rank."""
    return lookup(_c(rank), {v: k for k, v in SEVERITIES.items()})


def finding_severity_label(score: Column | str) -> Column:
    """Published bands of a cloud detection score."""
    s = _c(score)
    return (
        F.when(s >= 9, "CRITICAL").when(s >= 7, "HIGH").when(s >= 4, "MEDIUM").otherwise("LOW")
    )


def delta_pct(value: Column | str, prior: Column | str) -> Column:
    """Percentage change against ``prior``; null without a prior or when it is zero."""
    v, p = _c(value).cast("double"), _c(prior).cast("double")
    return F.when(p != 0, (v - p) / F.abs(p) * 100.0)


def daypart(ts: Column | str, timezone: str) -> Column:
    """Part of the site-local day a UTC timestamp falls into."""
    hour = F.hour(F.from_utc_timestamp(_c(ts), timezone))
    return F.element_at(F.array(*[F.lit(d) for d in DAYPARTS]), (F.floor(hour / 6) + 1).cast("int"))


def human_interval(seconds: Column | str) -> Column:
    """Interval in the unit a reader expects."""
    s = _c(seconds)
    return (
        F.when(s < 90, F.format_string("%.0fs", s))
        .when(s < 5400, F.format_string("%.1fmin", s / 60))
        .otherwise(F.format_string("%.1fh", s / 3600))
    )


def short_arn(arn: Column | str) -> Column:
    """Last path part of a cloud resource name, or its last colon part."""
    c = _c(arn)
    return F.when(c.contains("/"), F.substring_index(c, "/", -1)).otherwise(
        F.substring_index(c, ":", -1)
    )


def is_mac(text: Column | str) -> Column:
    """True for a lower-case colon-separated hardware address."""
    return _c(text).rlike("^[0-9a-f]{2}(:[0-9a-f]{2}){5}$")


def is_allowed_action(action: Column | str) -> Column:
    """True unless the action stopped the packet; no action at all counts as allowed."""
    return ~F.coalesce(F.lower(_c(action)), F.lit("")).isin(*BLOCKING_ACTIONS)


def ip_verdict(score: Column | str, whitelisted: Column | str) -> Column:
    """Verdict from an address reputation score."""
    s = _c(score)
    return (
        F.when(_c(whitelisted), "benign")
        .when(s.isNull(), "unknown")
        .when(s >= 80, "malicious")
        .when(s >= 50, "suspicious")
        .when(s >= 25, "unknown")
        .otherwise("benign")
    )


def domain_verdict(malicious: Column | str, level: Column | str, score: Column | str) -> Column:
    """Verdict from a domain reputation answer."""
    lev = _c(level)
    return (
        F.when(_c(malicious) | (lev == "critical"), "malicious")
        .when(lev == "high", "suspicious")
        .when(lev == "medium", "unknown")
        .when((lev == "low") | (_c(score) < 25), "benign")
        .otherwise("unknown")
    )


def ip_categories(is_tor: Column | str, usage_type: Column | str) -> Column:
    """Category labels of an address reputation answer."""
    usage = F.lower(F.coalesce(_c(usage_type), F.lit("")))
    return F.array_compact(
        F.array(
            F.when(_c(is_tor), F.lit("tor-exit")),
            F.when(usage.contains("data center") | usage.contains("hosting"), F.lit("datacenter")),
            F.when(usage.contains("fixed line isp") | usage.contains("mobile"), F.lit("residential")),
        )
    )


def entity(type_: str, value: Column | str, role: str = "") -> Column:
    """One entity of a signal."""
    return F.struct(
        F.lit(type_).alias("type"), _c(value).cast("string").alias("value"), F.lit(role).alias("role")
    )


def entity_list(type_: str, values: Column | str, role: str = "") -> Column:
    """Entities of one type and role from a short array of values."""
    return F.transform(_c(values), lambda v: entity(type_, v, role))
