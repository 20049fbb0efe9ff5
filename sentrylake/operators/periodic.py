"""Periodic check-ins over DNS and connection records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake.functions.scalars import entity, human_interval
from sentrylake.operators import metrics as M
from sentrylake.operators import query as q
from sentrylake.operators import series
from sentrylake.operators.history import Baseline, with_recurrence
from sentrylake.operators.signals import as_signals, text
from sentrylake.profile import Profile
from sentrylake.schema import HIGH, MEDIUM

ANALYZER = "beaconing"
TAXONOMY = "c2.beacon_candidate"

_SCORES = ["interval_seconds", "jitter_seconds", "cv", "samples", "span_hours"]


def dns_series(events: DataFrame, profile: Profile, **limits) -> DataFrame:
    """Scored (client, domain) series, harmless domains left out before anything is grouped."""
    rows = q.where(events, kind="dns").where(
        F.col("client_ip").isNotNull() & (F.col("domain") != "")
    )
    rows = rows.where(~profile.is_benign_domain("domain"))
    return series.beacon_scores(rows, ["client_ip", "domain"], **limits)


def flow_series(events: DataFrame, profile: Profile, **limits) -> DataFrame:
    """Scored (inside source, outside destination) series of connection records."""
    rows = q.where(events, kind="flow").where((F.col("src_ip") != "") & (F.col("dst_ip") != ""))
    scored = series.beacon_scores(rows, ["src_ip", "dst_ip"], **limits)
    return scored.where(profile.is_internal("src_ip") & profile.is_external("dst_ip"))


def dns_beacons(
    events: DataFrame, profile: Profile, baseline: Baseline | None = None, **limits
) -> DataFrame:
    rows = with_recurrence(dns_series(events, profile, **limits), baseline, TAXONOMY, "domain")
    return as_signals(
        rows,
        signal_id=text("beacon.dns.", F.col("client_ip"), ".", F.col("domain")),
        analyzer=ANALYZER,
        title=text(
            "Periodic DNS from ", profile.label_for("client_ip"), " to ", F.col("domain"),
            " every ~", human_interval("interval_seconds"),
        ),
        taxonomy=TAXONOMY,
        severity=MEDIUM,
        confidence=F.col("confidence"),
        entities=F.array(
            entity("ip", "client_ip", "client"), entity("domain", "domain", "destination")
        ),
        evidence=[
            F.col("client_ip").alias("client"), "domain", *_SCORES,
            profile.attribution_caveat("client_ip").alias("attribution_caveat"), "prior_runs",
        ],
    )


def flow_beacons(events: DataFrame, profile: Profile, **limits) -> DataFrame:
    rows = flow_series(events, profile, **limits)
    return as_signals(
        rows,
        signal_id=text("beacon.flow.", F.col("src_ip"), ".", F.col("dst_ip")),
        analyzer=ANALYZER,
        title=text(
            "Periodic egress ", profile.label_for("src_ip"), " -> ", F.col("dst_ip"), " every ~",
            human_interval("interval_seconds"),
        ),
        taxonomy=TAXONOMY,
        severity=HIGH,
        confidence=F.least(F.lit(0.95), F.col("confidence") + 0.1),
        entities=F.array(
            entity("ip", "src_ip", "source"), entity("ip", "dst_ip", "destination")
        ),
        evidence=[
            F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst"), *_SCORES,
            profile.attribution_caveat("src_ip").alias("attribution_caveat"),
        ],
    )


def beacon_metrics(events: DataFrame, profile: Profile, **limits) -> DataFrame:
    """Number of periodic series found in DNS and connection records."""
    found = (
        dns_series(events, profile, **limits)
        .select(F.lit(1).alias("one"))
        .unionAll(flow_series(events, profile, **limits).select(F.lit(1).alias("one")))
        .agg(F.count("*").alias("n"))
    )
    return M.stats(found, [M.Stat("beacon.candidates", "n", "dns", "Beacon candidates")], 4000)
