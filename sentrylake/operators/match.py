"""Matching of observed values against indicator lists, as equi-joins.

An indicator frame has the columns ``value, kind (ip|cidr|domain|domain_suffix), severity, tier,
source, campaign, warning, expires, origin``. No join here is hinted: list sizes are not known in
advance, so Spark picks broadcast or sort-merge from the sizes it sees and splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake.functions import domains, net

DETAILS = ("severity", "tier", "source", "campaign", "warning", "expires", "origin")


def _indicator_columns(indicators: DataFrame) -> list:
    have = [c for c in DETAILS if c in indicators.columns]
    return [F.col("value").alias("indicator"), F.col("kind"), *have]


def _keyed(values: DataFrame, name: str) -> DataFrame:
    """Distinct values with their address key.

    The key passes through an explode of one element, below which no filter on it can be pushed:
    without that, the null test of the join would parse every row instead of every distinct value.
    """
    distinct = values.select("value").distinct()
    return distinct.withColumn(name, F.explode(F.array(net.ip_hex("value"))))


def match_exact_ips(values: DataFrame, indicators: DataFrame) -> DataFrame:
    """Addresses (column ``value``) that equal an ``ip`` indicator, whatever their spelling."""
    listed = indicators.where(F.col("kind") == "ip").select(
        *_indicator_columns(indicators), net.ip_hex("value").alias("_key")
    )
    seen = _keyed(values, "_key")
    return seen.join(listed.where(F.col("_key").isNotNull()), "_key").drop("_key")


def match_networks(values: DataFrame, indicators: DataFrame) -> DataFrame:
    """Addresses inside a ``cidr`` indicator; every covering network is returned.

    Each distinct address is expanded to one key per prefix length that the list uses (at most the
    lengths an address has), and joined on (address family, length, leading bits).
    """
    nets = (
        indicators.where(F.col("kind") == "cidr")
        .select(
            *_indicator_columns(indicators),
            net.ip_hex(F.split_part("value", F.lit("/"), F.lit(1))).alias("_hex"),
            F.split_part("value", F.lit("/"), F.lit(2)).try_cast("int").alias("_plen"),
        )
        .where(F.col("_hex").isNotNull())
        .withColumn("_digits", F.length("_hex"))
        .withColumn("_plen", F.coalesce(F.col("_plen"), F.col("_digits") * 4))
        .withColumn("_key", net.hex_prefix(F.col("_hex"), F.col("_plen")))
        .drop("_hex")
    )
    lengths = nets.select(F.collect_set(F.struct("_digits", "_plen")).alias("lens")).scalar()
    keyed = (
        _keyed(values, "_hex")
        .withColumn("_len", F.explode(lengths))
        .where(F.col("_len._digits") == F.length("_hex"))
        .select(
            "value",
            F.col("_len._digits").alias("_digits"),
            F.col("_len._plen").alias("_plen"),
            net.hex_prefix(F.col("_hex"), F.col("_len._plen")).alias("_key"),
        )
    )
    return keyed.join(nets, ["_digits", "_plen", "_key"]).drop("_digits", "_plen", "_key")


def match_ips(values: DataFrame, indicators: DataFrame) -> DataFrame:
    """Addresses covered by an ``ip`` or ``cidr`` indicator, one row per pair."""
    return match_exact_ips(values, indicators).unionByName(match_networks(values, indicators))


def match_domains(values: DataFrame, indicators: DataFrame) -> DataFrame:
    """Names equal to, or under, a domain indicator: each name is expanded to its suffixes."""
    listed = indicators.where(F.col("kind").isin("domain", "domain_suffix")).select(
        *_indicator_columns(indicators), F.col("value").alias("_key")
    )
    keyed = (
        values.select("value")
        .distinct()
        .withColumn("_key", F.explode(domains.domain_suffixes(domains.match_form("value"))))
    )
    return keyed.join(listed, "_key").drop("_key")


def not_under(values: DataFrame, suffixes: DataFrame, column: str = "domain") -> DataFrame:
    """Rows whose name is neither equal to nor under one of ``suffixes`` (column ``suffix``)."""
    names = values.select(F.col(column).alias("_name")).distinct()
    keyed = names.withColumn("_key", F.explode(domains.domain_suffixes("_name")))
    listed = suffixes.select(F.col("suffix").alias("_key")).distinct()
    covered = keyed.join(listed, "_key", "left_semi").select("_name").distinct()
    return values.join(covered, values[column] == covered["_name"], "left_anti")
