"""Change against the prior run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake.functions.scalars import entity, lookup
from sentrylake.operators import metrics as M
from sentrylake.operators import query as q
from sentrylake.operators.history import Baseline
from sentrylake.operators.signals import as_signals, text
from sentrylake.schema import LOW

ANALYZER = "baseline_delta"

# Metrics compared with the prior run, and how a reader knows them.
WATCHED = {
    "fw.drops": "firewall DROPs",
    "fw.unique_sources": "unique external sources",
    "dns.total": "DNS queries",
    "dns.blocked": "blocked DNS queries",
    "dns.unique_domains": "unique domains",
    "beacon.candidates": "beacon candidates",
}


def current_values(events: DataFrame, beacons: DataFrame | None = None) -> DataFrame:
    """Watched values of this run (``key, now``); ``beacons`` (column ``n``) adds the sixth."""
    fw, dns = F.col("kind") == "firewall", F.col("kind") == "dns"
    row = q.where(events, kind=["firewall", "dns"]).agg(
        F.count_if(fw & (F.col("action") == "drop")).alias("fw.drops"),
        F.count_distinct(F.when(fw, F.col("src_ip"))).alias("fw.unique_sources"),
        F.count_if(dns).alias("dns.total"),
        F.count_if(dns & (F.col("blocked") == F.lit(True))).alias("dns.blocked"),
        F.count_distinct(F.when(dns, F.col("domain"))).alias("dns.unique_domains"),
    )
    pairs = [
        F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("double").alias("now"))
        for c in row.columns
    ]
    values = row.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    if beacons is not None:
        extra = beacons.select(
            F.lit("beacon.candidates").alias("key"), F.col("n").cast("double").alias("now")
        )
        values = values.unionByName(extra)
    return values


def changes(
    events: DataFrame, baseline: Baseline, beacons: DataFrame | None = None
) -> DataFrame:
    """Watched values beside the prior run: ``key, now, before, ratio, change_pct``."""
    before = baseline.prior.select("key", F.col("prior").alias("before"))
    return (
        current_values(events, beacons)
        .join(before, "key")
        .where(F.col("before") > 0)
        .withColumn("ratio", F.col("now") / F.col("before"))
        .withColumn("change_pct", (F.col("now") - F.col("before")) / F.col("before") * 100.0)
    )


def trend_metrics(events: DataFrame, baseline: Baseline) -> DataFrame:
    """Whether there is a baseline, and the percentage change of every watched value."""
    present = events.sparkSession.range(1).select(
        F.when(baseline.prior.select("key").exists(), 1).otherwise(0).alias("n")
    )
    rows = changes(events, baseline).select(
        F.concat(F.lit("trend."), "key", F.lit(".change_pct")).alias("value"),
        F.col("change_pct").alias("n"),
        F.concat(F.lit("Change in "), lookup(F.col("key"), WATCHED)).alias("label"),
    )
    change = M.ranking(rows, prefix="", section="trend", start=9001, label=F.col("label"))
    return M.all_of(
        M.stats(
            present, [M.Stat("trend.baseline_available", "n", "trend", "Baseline available")], 9000
        ),
        change.withColumn("unit", F.lit("%")),
    )


def magnitude_shift(events: DataFrame, baseline: Baseline, *, factor: float = 10.0) -> DataFrame:
    """Watched values that moved by an order of magnitude: more often a collection defect."""
    rows = changes(events, baseline).where(
        (F.col("ratio") >= factor) | (F.col("ratio") <= 1 / factor)
    )
    return as_signals(
        rows,
        signal_id=text("trend.anomaly.", F.col("key")),
        analyzer=ANALYZER,
        title=text(lookup(F.col("key"), WATCHED), " moved by more than an order of magnitude"),
        taxonomy="dataquality.magnitude_shift",
        severity=LOW,
        confidence=0.5,
        entities=F.array(entity("host", F.lit("pipeline"))),
        evidence=[
            F.col("key").alias("metric"), F.col("before").alias("prior"),
            F.col("now").alias("current"), "ratio",
        ],
    )


def change_notes(
    events: DataFrame, baseline: Baseline, *, factor: float = 10.0, material_pct: float = 60.0
) -> DataFrame:
    """A line of text for every material change below an order of magnitude."""
    rows = changes(events, baseline).where(
        (F.col("ratio") < factor)
        & (F.col("ratio") > 1 / factor)
        & (F.abs("change_pct") >= material_pct)
    )
    return rows.select(
        "key",
        F.format_string(
            "%s changed %+.0f%% versus the prior run (%.0f -> %.0f)",
            lookup(F.col("key"), WATCHED), "change_pct", "before", "now",
        ).alias("note"),
    )
