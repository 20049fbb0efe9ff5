"""One table of known devices, merged by address from every source that describes them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake.functions.net import ip_hex, is_private_address
from sentrylake.operators import query as q
from sentrylake.sources.syslog import dhcp_lease

FIELDS = ("hostname", "hardware", "os", "version", "status", "location", "uptime_seconds", "mac")


def contribution(df: DataFrame, *, source: str, role: str, ord: int) -> DataFrame:
    """Bring one source's device facts into the common layout; ``ord`` is its turn."""
    have = set(df.columns)
    return df.select(
        F.trim("ip").alias("ip"),
        F.lit(source).alias("source"),
        F.lit(role).alias("role"),
        F.lit(ord).alias("ord"),
        *[(F.col(f) if f in have else F.lit(None)).cast("string").alias(f) for f in FIELDS],
    )


def managed_devices(inventory: DataFrame, ord: int = 0) -> DataFrame:
    """Devices of a network inventory (``ip, hostname, hardware, os, version, status, ..``)."""
    return contribution(inventory, source="syslog", role="managed", ord=ord)


def dhcp_devices(events: DataFrame, ord: int = 1) -> DataFrame:
    """Devices that were granted a lease: address, hardware address and host name."""
    grants = q.where(events, program="DNSMASQ-DHCP", action="dhcpack").where(F.col("src_ip") != "")
    host = dhcp_lease(F.coalesce("message", F.lit("")))["hostname"]
    rows = grants.select(F.col("src_ip").alias("ip"), host.alias("hostname"), F.col("user").alias("mac"))
    return contribution(rows.distinct(), source="syslog", role="dhcp-client", ord=ord)


def dns_devices(clients: DataFrame, ord: int = 2) -> DataFrame:
    """Clients of a resolver (``ip, hostname``)."""
    return contribution(clients, source="resolver", role="dns-client", ord=ord)


def device_directory(*contributions: DataFrame, include_public: bool = False) -> DataFrame:
    """Facts merged per address: per field the first non-empty value in turn, all roles and sources.

    Public addresses are left out by default: the table describes one's own network.
    """
    facts = reduce(lambda a, b: a.unionByName(b), contributions).where(F.col("ip") != "")
    if not include_public:
        facts = facts.where(ip_hex("ip").isNull() | is_private_address("ip"))
    first = [
        F.min_by(
            F.nullif(F.col(f), F.lit("")),
            F.when(F.coalesce(F.col(f), F.lit("")) != "", F.struct("ord", F.col(f))),
        ).alias(f)
        for f in FIELDS
    ]
    # Roles and sources are a handful of fixed words, so these sets are tiny.
    merged = facts.groupBy("ip").agg(
        *first,
        F.array_sort(F.collect_set("role")).alias("roles"),
        F.array_sort(F.collect_set("source")).alias("sources"),
    )
    return merged.withColumn("sort_key", ip_hex("ip"))


def in_address_order(directory: DataFrame) -> DataFrame:
    """Numeric address order, IPv4 before IPv6, other names last."""
    key = F.col("sort_key")
    return directory.orderBy(key.isNull(), F.length(key), key, "ip")
