"""Outbound data volume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake.functions.scalars import entity
from sentrylake.operators import metrics as M
from sentrylake.operators import query as q
from sentrylake.operators import series
from sentrylake.operators.history import Baseline
from sentrylake.operators.signals import as_signals, text
from sentrylake.profile import Profile
from sentrylake.schema import LOW, MEDIUM

ANALYZER = "data_volume"
MIB = 1024 * 1024


def outbound_pairs(events: DataFrame, profile: Profile) -> DataFrame:
    """Accepted bytes per (inside source, outside destination)."""
    pairs = q.bytes_by_pair(events, None, kind="firewall", action="accept").where(
        (F.col("src_ip") != "") & (F.col("dst_ip") != "")
    )
    return pairs.where(profile.is_internal("src_ip") & ~profile.is_internal("dst_ip"))


def volume_metrics(events: DataFrame, profile: Profile) -> DataFrame:
    total = outbound_pairs(events, profile).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n"))
    return M.stats(
        total,
        [
            M.Stat(
                "fw.bytes.outbound_accepted", "n", "perimeter",
                "Outbound accepted bytes (approx.)", unit="bytes",
            )
        ],
        5500,
    )


def volume_outlier(
    events: DataFrame,
    profile: Profile,
    *,
    min_sources: int = 3,
    floor_bytes: int = 50 * MIB,
    multiple: float = 5.0,
) -> DataFrame:
    """Sources that sent far more than the mean of all others."""
    sent = (
        outbound_pairs(events, profile)
        .groupBy("src_ip")
        .agg(F.sum("bytes").alias("outbound_accepted_bytes"))
    )
    sources = sent.agg(F.count("*")).scalar()
    rows = (
        sent.withColumn("network_mean_bytes", series.peer_mean(sent, "outbound_accepted_bytes"))
        .where(sources >= min_sources)
        .where(
            F.col("outbound_accepted_bytes")
            >= F.greatest(F.lit(float(floor_bytes)), F.col("network_mean_bytes") * multiple)
        )
    )
    return as_signals(
        rows,
        signal_id=text("data.volume_outlier.", F.col("src_ip")),
        analyzer=ANALYZER,
        title=text(profile.label_for("src_ip"), " sent far more outbound data than its peers"),
        taxonomy="data.volume_outlier",
        severity=MEDIUM,
        confidence=0.5,
        entities=F.array(entity("ip", "src_ip", "source")),
        evidence=[
            F.col("src_ip").alias("src"), "outbound_accepted_bytes", "network_mean_bytes",
            F.try_divide(F.col("outbound_accepted_bytes"), F.col("network_mean_bytes")).alias(
                "multiple_of_mean"
            ),
            profile.attribution_caveat("src_ip").alias("attribution_caveat"),
        ],
    )


def large_transfer(
    events: DataFrame,
    profile: Profile,
    baseline: Baseline | None = None,
    *,
    floor_bytes: int = 200 * MIB,
    listed: int | None = None,
) -> DataFrame:
    """Large single transfers, the largest ``listed`` if given; more serious towards a destination never seen before."""
    pairs = outbound_pairs(events, profile).where(F.col("bytes") >= floor_bytes)
    if listed is not None:
        pairs = pairs.orderBy(F.desc("bytes"), "src_ip", "dst_ip").limit(listed)
    if baseline is None:
        rows = pairs.withColumn("destination_is_novel", F.lit(True))
    else:
        fresh = baseline.novel(pairs.select(F.col("dst_ip").alias("value")).distinct(), "ip")
        fresh = fresh.select(F.col("value").alias("_new"))
        rows = (
            pairs.join(fresh, pairs["dst_ip"] == fresh["_new"], "left")
            .withColumn("destination_is_novel", F.col("_new").isNotNull())
            .drop("_new")
        )
    new = F.col("destination_is_novel")
    return as_signals(
        rows,
        signal_id=text("data.large_transfer.", F.col("src_ip"), ".", F.col("dst_ip")),
        analyzer=ANALYZER,
        title=text(
            "Large outbound transfer from ", profile.label_for("src_ip"), " to ", F.col("dst_ip")
        ),
        taxonomy="data.large_transfer",
        severity=F.when(new, MEDIUM).otherwise(LOW),
        confidence=F.when(new, 0.6).otherwise(0.45),
        entities=F.array(
            entity("ip", "src_ip", "source"), entity("ip", "dst_ip", "destination")
        ),
        evidence=[
            F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst"), "bytes", "hits",
            "destination_is_novel",
            profile.attribution_caveat("src_ip").alias("attribution_caveat"),
        ],
    )
