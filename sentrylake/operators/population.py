"""Devices seen for the first time, by address and by hardware address."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.functions.scalars import entity_list, is_mac
from sentrylake.operators import metrics as M
from sentrylake.operators import query as q
from sentrylake.operators.history import Baseline
from sentrylake.operators.signals import as_signals, text
from sentrylake.profile import Profile
from sentrylake.schema import LOW, MEDIUM, UNTRUSTED

ANALYZER = "novel_clients"


def novel_addresses(events: DataFrame, profile: Profile, baseline: Baseline) -> DataFrame:
    """New inside addresses (``value, zone``) among firewall sources and DNS clients."""
    address = F.when(F.col("kind") == "dns", F.col("client_ip")).otherwise(F.col("src_ip"))
    seen = (
        q.where(events, kind=["firewall", "dns"])
        .select(address.alias("value"))
        .where(F.col("value") != "")
        .distinct()
        .withColumn("zone", profile.zone_of("value"))
        .where(F.col("zone") != "external")
    )
    return baseline.when_present(baseline.novel(seen, "ip"))


def novel_client(
    events: DataFrame, profile: Profile, baseline: Baseline, *, listed: int = 15
) -> DataFrame:
    """One signal per zone with new inside addresses."""
    fresh = novel_addresses(events, profile, baseline)
    order = Window.partitionBy("zone").orderBy("value")
    shown = (
        fresh.withColumn("_r", F.row_number().over(order))
        .where(F.col("_r") <= listed)
        .groupBy("zone")
        .agg(F.sort_array(F.collect_list("value")).alias("ips"))
    )
    rows = (
        fresh.groupBy("zone")
        .agg(F.count("*").alias("count"))
        .join(shown, "zone")
        .withColumn("trust", profile.trust_of("zone"))
    )
    return as_signals(
        rows,
        signal_id=text("net.novel_client.", F.col("zone")),
        analyzer=ANALYZER,
        title=text(
            F.col("count"), " new device(s) active on ", F.col("zone"), " for the first time"
        ),
        taxonomy="net.novel_client",
        severity=F.when(F.col("trust").isin(*UNTRUSTED), MEDIUM).otherwise(LOW),
        confidence=0.55,
        entities=entity_list("ip", "ips", "client"),
        evidence=["zone", "trust", "count", F.transform("ips", profile.label_for).alias("ips")],
    )


def novel_client_metrics(events: DataFrame, profile: Profile, baseline: Baseline) -> DataFrame:
    found = novel_addresses(events, profile, baseline).agg(F.count("*").alias("n"))
    return M.stats(
        found.where(F.col("n") > 0),
        [M.Stat("net.novel_clients", "n", "general", "New internal devices")],
        3500,
    )


def novel_device_mac(events: DataFrame, baseline: Baseline, *, listed: int = 20) -> DataFrame:
    """New hardware addresses, which survive a change of lease."""
    macs = q.distinct_values(events, "user", kind=["system", "auth"]).where(is_mac("value"))
    fresh = baseline.when_present(baseline.novel(macs, "device"))
    shown = fresh.orderBy("value").limit(listed).agg(F.sort_array(F.collect_list("value")))
    rows = (
        fresh.agg(F.count("*").alias("count"))
        .where(F.col("count") > 0)
        .withColumn("macs", shown.scalar())
    )
    return as_signals(
        rows,
        signal_id="net.novel_device_mac",
        analyzer=ANALYZER,
        title=text(F.col("count"), " new device identity (MAC) seen for the first time"),
        taxonomy="net.novel_device_mac",
        severity=LOW,
        confidence=0.5,
        entities=entity_list("host", "macs", "client"),
        evidence=["count", "macs"],
    )
