"""Indicator lists (CSV with a header, or plain text) to an indicator frame."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.functions import domains, net
from sentrylake.functions.scalars import TIER_SEVERITY, lookup
from sentrylake.schema import LOW, SEVERITIES

# Declared types and what they are; the shortest prefixes that still say something.
TYPE_NAMES = {
    "ip": "ip", "ipv4": "ip", "ipv6": "ip", "ip-dst": "ip", "ip-src": "ip",
    "ipv4-addr": "ip", "ipv6-addr": "ip",
    "cidr": "cidr", "ipv4-cidr": "cidr", "ipv6-cidr": "cidr", "ip-range": "cidr",
    "domain": "domain", "hostname": "domain", "fqdn": "domain", "domain-name": "domain",
    "domain-suffix": "domain_suffix", "domain_suffix": "domain_suffix",
}
MIN_PREFIX_V4 = 8
MIN_PREFIX_V6 = 32
TEXT_LIMIT = 300
DOMAIN_PATTERN = (
    r"^(?=.{1,253}$)([a-z0-9_](?:[a-z0-9_-]{0,61}[a-z0-9])?\.)+[a-z0-9-]{2,63}$"
)

# Columns of a list, with the spellings under which each may appear.
_COLUMNS = {
    "indicator": ("indicator", "value", "ioc"),
    "type": ("type",),
    "tier": ("tier",),
    "severity": ("severity",),
    "source": ("source",),
    "campaign": ("campaign",),
    "warning": ("warning", "notes"),
    "until": ("alert_until", "valid_until", "expires"),
}


def _given(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def read_list(spark: SparkSession, path: str, origin: str | None = None) -> DataFrame:
    """Rows of one list in a common layout; missing columns are null."""
    origin = origin or path.rstrip("/").rsplit("/", 1)[-1]
    if path.lower().endswith(".csv"):
        rows = spark.read.option("header", True).option("multiLine", True).csv(path)
        names = {c.strip().lstrip("﻿").lower(): c for c in rows.columns}
        columns = []
        for target, spellings in _COLUMNS.items():
            found = [_given(F.col(f"`{names[s]}`")) for s in spellings if s in names]
            value = F.coalesce(*found) if found else F.lit(None).cast("string")
            columns.append(value.alias(target))
        rows = rows.select(*columns)
    else:
        line = _given(F.split_part(F.regexp_replace("value", "^﻿", ""), F.lit("#"), F.lit(1)))
        rows = spark.read.text(path).select(
            line.alias("indicator"), *[F.lit(None).cast("string").alias(c) for c in _COLUMNS if c != "indicator"]
        )
    return rows.withColumn("origin", F.lit(origin)).withColumn("_row", F.monotonically_increasing_id())


def infer_kind(raw: Column) -> Column:
    """Kind of an undeclared indicator from its shape."""
    address = F.split_part(raw, F.lit("/"), F.lit(1))
    is_address = net.ip_hex(address).isNotNull()
    return (
        F.when(raw.startswith("*.") | raw.startswith("."), "domain_suffix")
        .when(is_address & raw.contains("/"), "cidr")
        .when(is_address, "ip")
        .otherwise("domain")
    )


def _canonical_v6(hex6: Column) -> Column:
    """Shortest text of an IPv6 address: leading zeros dropped, the longest run of zero groups
    (the first of equals, at least two) written as "::"."""
    groups = F.regexp_replace(hex6, "(.{4})(?=.)", "$1:")

    def shortest(plain: Column) -> Column:
        text = None
        for run in range(8, 1, -1):
            pattern = f"^((?:[0-9a-f]+:)*?)0(?::0){{{run - 1}}}(?::([0-9a-f:]*))?$"
            short = F.concat(
                F.regexp_replace(F.regexp_extract(plain, pattern, 1), ":$", ""),
                F.lit("::"),
                F.regexp_extract(plain, pattern, 2),
            )
            text = (F if text is None else text).when(plain.rlike(pattern), short)
        return text.otherwise(plain)

    return net.bind(F.regexp_replace(groups, "(^|:)0{1,3}(?=[0-9a-f])", "$1"), shortest)


def _canonical_v4(value: Column) -> Column:
    parts = [F.floor(value / (1 << shift)).cast("bigint") % 256 for shift in (24, 16, 8, 0)]
    return F.concat_ws(".", *[p.cast("string") for p in parts])


def canonical_ip(ip: Column | str) -> Column:
    """Canonical text of an address, null when invalid."""
    c = F.col(ip) if isinstance(ip, str) else ip
    return F.when(net.is_ipv4(c), c).when(c.contains(":"), _canonical_v6(net.ipv6_hex(c)))


def _canonical_network(raw: Column) -> Column:
    """Canonical text of a network with its host bits cleared; null when invalid or too wide."""
    address = F.split_part(raw, F.lit("/"), F.lit(1))
    size = F.split_part(raw, F.lit("/"), F.lit(2))
    plen = F.when(size.rlike("^[0-9]{1,3}$"), size.try_cast("int"))
    step = F.pow(F.lit(2).cast("double"), F.lit(32) - plen).cast("bigint")
    low4 = F.floor(net.ipv4_value(address) / step).cast("bigint") * step
    low6 = F.rpad(net.hex_prefix(net.ipv6_hex(address), plen), 32, "0")
    v4 = F.concat(net.bind(low4, _canonical_v4), F.lit("/"), plen.cast("string"))
    v6 = F.concat(_canonical_v6(low6), F.lit("/"), plen.cast("string"))
    return F.when(net.is_ipv4(address) & plen.between(MIN_PREFIX_V4, 32), v4).when(
        address.contains(":") & plen.between(MIN_PREFIX_V6, 128), v6
    )


def normalize_indicator(raw: Column, kind: Column) -> Column:
    """Canonical indicator of a kind: address, network or lower-case domain; null when invalid."""
    name = F.regexp_replace(F.lower(raw), r"^\*\.", "")
    name = F.regexp_replace(F.regexp_replace(name, r"^\.+|\.+$", ""), "^[a-z]+://", "")
    name = F.split_part(F.split_part(name, F.lit("/"), F.lit(1)), F.lit(":"), F.lit(1))
    number = F.when(raw.contains("/"), _canonical_network(raw)).otherwise(canonical_ip(raw))
    return F.when(kind.isin("ip", "cidr"), number).when(
        kind.isin("domain", "domain_suffix") & name.rlike(DOMAIN_PATTERN), name
    )


def classify(rows: DataFrame, today: date) -> DataFrame:
    """List rows with their normal form and what became of them (``status``): usable, skipped
    (a type the events cannot show), invalid, expired, or blank."""
    declared = F.lower(F.trim("type"))

    def parsed(raw: Column) -> Column:
        kind = F.when(declared.isNotNull(), lookup(declared, TYPE_NAMES)).otherwise(infer_kind(raw))
        return net.bind(
            kind,
            lambda k: F.struct(
                raw.alias("raw"), k.alias("kind"), normalize_indicator(raw, k).alias("value")
            ),
        )

    rows = rows.withColumn(
        "_p", net.bind(domains.refang(F.coalesce("indicator", F.lit(""))), parsed)
    ).select("*", "_p.*", declared.alias("declared")).drop("_p")
    tier = F.upper(F.trim("tier"))
    ranks = {t: SEVERITIES[s] for t, s in TIER_SEVERITY.items()}
    stated = lookup(F.upper(F.trim("severity")), {k: max(0, v) for k, v in SEVERITIES.items()})
    until = F.substring(F.trim("until"), 1, 10)
    until = F.when(until.rlike(r"^\d{4}-\d{2}-\d{2}$"), until.try_cast("date"))
    rows = rows.withColumns(
        {
            "tier": F.coalesce(F.when(tier.isin(*TIER_SEVERITY), tier), F.lit("")),
            "severity": F.coalesce(lookup(tier, ranks), stated, F.lit(LOW)).cast("int"),
            "expires": until,
            "kind": F.when((F.col("kind") == "ip") & F.col("value").contains("/"), "cidr").otherwise(F.col("kind")),
        }
    )
    status = (
        F.when(F.col("raw") == "", "blank")
        .when(F.col("kind").isNull(), "skipped")
        .when(F.col("value").isNull(), "invalid")
        .when(F.col("expires") < F.lit(today), "expired")
        .otherwise("usable")
    )
    return rows.withColumn("status", status)


def _capped(c: str) -> Column:
    text = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(
        F.length(text) > TEXT_LIMIT, F.concat(F.substring(text, 1, TEXT_LIMIT - 3), F.lit("..."))
    ).otherwise(text)


def indicators_of(classified: DataFrame) -> DataFrame:
    """Usable indicators; the same value in several rows keeps the highest severity, then the first."""
    kept = classified.where(F.col("status") == "usable")
    rank = F.struct(-F.col("severity"), "_file", "_row")
    details = ["severity", "tier", "source", "campaign", "warning", "expires", "origin"]
    texts = {c: _capped(c) for c in ("source", "campaign", "warning")}
    return (
        kept.withColumns(texts)
        .groupBy("kind", "value")
        .agg(F.min_by(F.struct(*details), rank).alias("d"))
        .select("value", "kind", "d.*")
    )


def list_summary(classified: DataFrame) -> DataFrame:
    """Rows per outcome, skipped rows per declared type."""
    detail = F.when(F.col("status") == "skipped", F.col("declared")).otherwise("")
    return (
        classified.where(F.col("status") != "blank")
        .groupBy("status", detail.alias("detail"))
        .agg(F.count("*").alias("n"))
    )


def load_lists(
    spark: SparkSession, paths: Sequence[str], today: date
) -> tuple[DataFrame, DataFrame]:
    """Indicators of several lists and a summary of what their rows became.

    Lists have their own headers, so each is read on its own; there are few of them.
    """
    frames = [
        read_list(spark, path).withColumn("_file", F.lit(i)) for i, path in enumerate(paths)
    ]
    rows = classify(reduce(lambda a, b: a.unionByName(b), frames), today)
    return indicators_of(rows), list_summary(rows)
