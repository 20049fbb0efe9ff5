"""Correlation across sources: shared hosts, watchlist activity, internal scanning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake.functions.scalars import entity
from sentrylake.operators import metrics as M
from sentrylake.operators import query as q
from sentrylake.operators.history import Baseline, active_watchlist
from sentrylake.operators.signals import as_signals, text
from sentrylake.profile import Profile
from sentrylake.schema import HIGH, MEDIUM

ANALYZER = "correlation"


def shared_hosts(events: DataFrame, profile: Profile) -> DataFrame:
    """Inside firewall sources that are also DNS clients."""
    clients = q.distinct_values(events, "client_ip", kind="dns")
    sources = q.distinct_values(events, "src_ip", kind="firewall")
    return sources.join(clients, "value", "left_semi").where(profile.is_internal("value"))


def shared_host_metrics(events: DataFrame, profile: Profile) -> DataFrame:
    found = shared_hosts(events, profile).agg(F.count("*").alias("n"))
    return M.stats(
        found.where(F.col("n") > 0),
        [
            M.Stat(
                "corr.dns_and_fw_hosts", "n", "general",
                "Hosts active in both DNS and firewall logs",
            )
        ],
        7000,
    )


def watch_activity(events: DataFrame, watchlist: DataFrame, as_of: str) -> DataFrame:
    """Events per watched entity (``entity_type, entity_value, reason, expires_at, n``).

    Each event plays several parts (source, destination, client, device, domain); a source that is
    also the destination counts twice. Parts are counted per value before the join, so the join
    sees one row per distinct value rather than one per event, and no value can be a hot key.
    """
    dns = F.col("kind") == "dns"
    part = lambda kind, value: F.struct(F.lit(kind).alias("part"), value.alias("value"))
    parts = (
        events.select(
            F.explode(
                F.array(
                    part("address", F.col("src_ip")),
                    part("address", F.col("dst_ip")),
                    part("address", F.when(dns, F.col("client_ip"))),
                    part("device", F.col("device")),
                    part("domain", F.when(dns, F.col("domain"))),
                )
            ).alias("p")
        )
        .where(F.col("p.value").isNotNull())
        .groupBy("p.part", "p.value")
        .agg(F.count("*").alias("n"))
    )
    roles = (
        F.when(F.col("entity_type") == "domain", F.array(F.lit("domain")))
        .when(F.col("entity_type") == "ip", F.array(F.lit("address")))
        .when(F.col("entity_type") == "host", F.array(F.lit("address"), F.lit("device")))
    )
    watched = active_watchlist(watchlist, as_of).withColumn("part", F.explode(roles))
    hits = watched.join(parts, (watched["part"] == parts["part"]) & (F.col("entity_value") == F.col("value")))
    return hits.groupBy("entity_type", "entity_value", "reason", "expires_at").agg(
        F.sum("n").alias("n")
    )


def watchlist_hit(events: DataFrame, baseline: Baseline) -> DataFrame:
    """Watched entities that were active again."""
    rows = watch_activity(events, baseline.watchlist, baseline.as_of).withColumn(
        "watch_expires",
        F.coalesce(F.date_format("expires_at", "yyyy-MM-dd"), F.lit("never")),
    )
    watched = F.struct(
        F.col("entity_type").alias("type"), F.col("entity_value").alias("value"),
        F.lit("").alias("role"),
    )
    return as_signals(
        rows,
        signal_id=text("corr.watchlist.", F.col("entity_type"), ".", F.col("entity_value")),
        analyzer=ANALYZER,
        title=text(
            "Watchlisted ", F.col("entity_type"), " ", F.col("entity_value"), " active again"
        ),
        taxonomy="watchlist.hit",
        severity=MEDIUM,
        confidence=0.7,
        entities=F.array(watched),
        evidence=[
            F.col("entity_value").alias("entity"), "entity_type",
            F.col("n").alias("events_this_period"), F.col("reason").alias("watch_reason"),
            "watch_expires",
        ],
    )


def internal_scan(
    events: DataFrame, profile: Profile, *, min_ports: int = 20, min_hits: int = 50
) -> DataFrame:
    """An inside host trying many destination ports."""
    rows = q.source_profile(events, kind="firewall").where(
        (F.col("distinct_dst_ports") >= min_ports) & (F.col("hits") >= min_hits)
    )
    rows = rows.where(profile.is_internal("src_ip"))
    return as_signals(
        rows,
        signal_id=text("corr.internal_scan.", F.col("src_ip")),
        analyzer=ANALYZER,
        title=text("Internal host ", profile.label_for("src_ip"), " probed many destination ports"),
        taxonomy="lateral.internal_scan",
        severity=HIGH,
        confidence=0.65,
        entities=F.array(entity("ip", "src_ip", "source")),
        evidence=[
            F.col("src_ip").alias("src"), "hits",
            F.col("distinct_dst_ports").alias("distinct_destination_ports"), "duration_hours",
        ],
    )
