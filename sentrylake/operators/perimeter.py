"""Firewall statistics and detections: volume, ports, spikes, sweeps, probers, traceroutes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.functions import net
from sentrylake.functions.scalars import entity, entity_list
from sentrylake.operators import metrics as M
from sentrylake.operators import query as q
from sentrylake.operators import series
from sentrylake.operators.history import Baseline, with_recurrence
from sentrylake.operators.signals import as_signals, entities_of, text, top_list
from sentrylake.profile import Profile
from sentrylake.schema import INFO, LOW, MEDIUM, UNTRUSTED
from sentrylake.session import materialize

DROPS = {"kind": "firewall", "action": "drop"}
VOLUME = "firewall_volume"
PATTERNS = "firewall_patterns"


def volume_metrics(events: DataFrame) -> DataFrame:
    """Totals by action, distinct sources, leading protocols and ingress interfaces."""
    fw = F.col("kind") == "firewall"
    totals = q.where(events, kind=["firewall", "system"]).agg(
        F.count_if(fw).alias("total"),
        F.count_if(fw & (F.col("action") == "drop")).alias("drops"),
        F.count_if(fw & (F.col("action") == "accept")).alias("accepts"),
        F.count_if(fw & (F.col("action") == "reject")).alias("rejects"),
        F.count_if(F.col("kind") == "system").alias("system"),
        F.count_distinct(F.when(fw, F.col("src_ip"))).alias("sources"),
    )
    return M.all_of(
        M.stats(
            totals,
            [
                M.Stat("fw.total", "total", "perimeter", "Firewall log lines"),
                M.Stat("fw.drops", "drops", "perimeter", "Firewall DROPs"),
                M.Stat("fw.accepts", "accepts", "perimeter", "Firewall ACCEPTs"),
                M.Stat("fw.rejects", "rejects", "perimeter", "Firewall REJECTs"),
                M.Stat("sys.events", "system", "router", "System/service events"),
                M.Stat("fw.unique_sources", "sources", "perimeter", "Unique external source IPs"),
            ],
            1000,
        ),
        M.ranking(
            q.top(events, "proto", 8, kind="firewall"),
            prefix="fw.proto.", section="perimeter", start=1010,
        ),
        M.ranking(
            q.top(events, "iface_in", 6, kind="firewall"),
            prefix="fw.iface.", section="perimeter", start=1020,
        ),
    )


def port_metrics(events: DataFrame, profile: Profile, *, watched_within: int | None = None) -> DataFrame:
    """Dropped ports by hits and by distinct sources, and every attack-surface port that was hit.

    One (port, source) grouping serves all three. ``watched_within`` restricts the attack-surface
    list to the most hit ports, as a bounded store query would.
    """
    drops = q.where(events, **DROPS).where(F.col("dst_port").isNotNull())
    per_source = drops.groupBy("dst_port", "src_ip").agg(F.count("*").alias("hits"))
    ports = per_source.groupBy(F.col("dst_port").alias("value")).agg(
        F.sum("hits").alias("n"), F.count("src_ip").alias("sources")
    )
    by_hits = ports.orderBy(F.desc("n"), "value").limit(20)
    by_sources = ports.orderBy(F.desc("sources"), "value").limit(20)
    pool = ports if watched_within is None else ports.orderBy(F.desc("n"), "value").limit(watched_within)
    watched = pool.where(F.col("value").isin(*profile.policy.attack_surface_ports))
    return M.all_of(
        M.ranking(by_hits, prefix="fw.port.hits.", section="ports", start=1030),
        M.ranking(
            by_sources, prefix="fw.port.sources.", section="ports", start=1031, measure="sources"
        ),
        M.ranking(watched, prefix="fw.attack_port.", section="ports", start=1032),
    )


def hourly_metrics(events: DataFrame) -> DataFrame:
    """Median, mean and peak of dropped packets per hour."""
    shape = series.hourly_shape(q.hourly(events, **DROPS)).where(F.col("hours_observed") > 0)
    return M.stats(
        shape.withColumn("peak", F.date_format("peak_hour", "yyyy-MM-dd HH:00")),
        [
            M.Stat("fw.hourly.median", "median_hourly", "perimeter", "Median DROPs/hour"),
            M.Stat("fw.hourly.mean", "mean_hourly", "perimeter", "Mean DROPs/hour"),
            M.Stat("fw.peak_hour", "peak", "perimeter", "Peak DROP hour", text=True),
            M.Stat("fw.peak_hour_count", "peak_count", "perimeter", "Peak hour DROPs"),
        ],
        1040,
    )


def volume_spike(events: DataFrame, *, min_hours: int = 6, multiple: float = 3.0) -> DataFrame:
    """The peak hour when it stands far above the median hour."""
    shape = series.hourly_shape(q.hourly(events, **DROPS)).where(
        (F.col("hours_observed") >= min_hours)
        & (F.col("median_hourly") > 0)
        & (F.col("peak_count") > F.col("median_hourly") * multiple)
    )
    leaders = top_list(q.top(events, "src_ip", 3, **DROPS))
    hour = F.date_format("peak_hour", "yyyy-MM-dd HH:00")
    rows = shape.withColumn("hour", hour).withColumn("top_sources", leaders)
    return as_signals(
        rows,
        signal_id=text("fw.spike.", F.replace(F.col("hour"), F.lit(" "), F.lit("T"))),
        analyzer=VOLUME,
        title=text("DROP volume spike at ", F.col("hour")),
        taxonomy="volume.spike",
        severity=LOW,
        confidence=0.55,
        entities=F.array(entity("host", F.lit("perimeter"), "target")),
        evidence=[
            "hour",
            F.col("peak_count").alias("count"),
            "median_hourly",
            (F.col("peak_count") / F.col("median_hourly")).alias("multiple_of_median"),
            "hours_observed",
            "top_sources",
        ],
    )


def sweep_prefixes(
    events: DataFrame,
    *,
    min_sources: int = 15,
    max_hits_per_source: float = 4.0,
    subnets: int | None = None,
) -> DataFrame:
    """/24s where many sources each knock a few times."""
    return (
        q.subnet_spread(events, subnets, **DROPS)
        .withColumn("hits_per_source", F.col("hits") / F.col("sources"))
        .where((F.col("sources") >= min_sources) & (F.col("hits_per_source") <= max_hits_per_source))
    )


def mass_sweep(events: DataFrame, **limits) -> DataFrame:
    rows = sweep_prefixes(events, **limits)
    return as_signals(
        rows,
        signal_id=text("fw.sweep.", F.replace(F.col("prefix"), F.lit("/"), F.lit("_"))),
        analyzer=PATTERNS,
        title=text("Mass scanner sweep from ", F.col("prefix")),
        taxonomy="scan.mass_sweep",
        severity=INFO,
        confidence=0.8,
        entities=F.array(entity("ip", "prefix", "source")),
        evidence=[
            "prefix",
            F.col("sources").alias("distinct_sources"),
            F.col("hits").alias("total_hits"),
            "hits_per_source",
        ],
    )


def source_shapes(events: DataFrame, **filters) -> DataFrame:
    """Everything the prober test needs per source, from one (source, port) grouping.

    Rolling (source, port) partial results up to the source replaces a distinct count, a ranking and
    a join; a hot source is already collapsed to one row per port before it reaches one task.
    """
    per_port = (
        q.where(events, **filters)
        .where(F.col("src_ip").isNotNull())
        .groupBy("src_ip", "dst_port")
        .agg(
            F.count("*").alias("n"),
            F.count_if(q.is_return_traffic()).alias("back"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
            F.min("ttl").alias("lo"),
            F.max("ttl").alias("hi"),
        )
    )
    best = F.col("_best")
    return (
        per_port.groupBy("src_ip")
        .agg(
            F.sum("n").alias("hits"),
            F.sum("back").alias("return_hits"),
            F.count("dst_port").alias("distinct_dst_ports"),
            F.max(series.packed_rank("n", "dst_port")).alias("_best"),
            F.min("first_ts").alias("first_seen"),
            F.max("last_ts").alias("last_seen"),
            F.min("lo").alias("ttl_min"),
            F.max("hi").alias("ttl_max"),
        )
        .withColumns({"top_port": series.packed_port(best), "top_port_hits": series.packed_hits(best)})
        .withColumn("duration_hours", F.round(q.hours_between("first_seen", "last_seen"), 2))
        .withColumn("port_concentration", F.col("top_port_hits") / F.col("hits"))
        .drop("_best")
    )


def persistent_prober(
    events: DataFrame,
    profile: Profile,
    baseline: Baseline | None = None,
    *,
    min_hits: int = 50,
    min_hours: float = 2.0,
    max_ports: int = 3,
    min_concentration: float = 0.7,
    max_return_share: float = 0.8,
    sweep: dict | None = None,
) -> DataFrame:
    """One outside source on few ports for hours, neither sweep member nor return traffic."""
    shapes = source_shapes(events, **DROPS).where(
        (F.col("hits") >= min_hits)
        & (F.col("duration_hours") >= min_hours)
        & (F.col("distinct_dst_ports") <= max_ports)
        & F.col("top_port").isNotNull()
        & (F.col("port_concentration") >= min_concentration)
        & (F.col("return_hits") <= F.col("hits") * max_return_share)
    )
    sweeps = sweep_prefixes(events, **(sweep or {})).select("prefix")
    outside = shapes.where(profile.is_external("src_ip")).withColumn(
        "prefix", net.subnet24("src_ip")
    )
    rows = outside.join(sweeps, "prefix", "left_anti")
    rows = with_recurrence(rows, baseline, "scan.persistent_prober", "src_ip")
    watched = F.col("top_port").isin(*profile.policy.attack_surface_ports)
    return as_signals(
        rows.withColumn("targets_attack_surface_port", watched),
        signal_id=text("fw.prober.", F.col("src_ip"), ".", F.col("top_port")),
        analyzer=PATTERNS,
        title=text("Sustained probe from ", F.col("src_ip"), " against port ", F.col("top_port")),
        taxonomy="scan.persistent_prober",
        severity=F.when(F.col("targets_attack_surface_port"), MEDIUM).otherwise(LOW),
        confidence=F.when(F.col("targets_attack_surface_port"), 0.75).otherwise(0.6),
        entities=F.array(
            entity("ip", "src_ip", "source"), entity("port", "top_port", "destination")
        ),
        evidence=[
            "hits", "duration_hours", "first_seen", "last_seen", "distinct_dst_ports", "top_port",
            "top_port_hits", "port_concentration", "ttl_min", "ttl_max",
            "targets_attack_surface_port", "prior_runs",
        ],
    )


def pattern_metrics(events: DataFrame, profile: Profile, **limits) -> DataFrame:
    """Return-traffic drops and the number of probers and sweeps found."""
    back = q.return_traffic_count(events, **DROPS).where(F.col("n") > 0)
    sweeps = sweep_prefixes(events, **limits).agg(F.count("*").alias("n"))
    sweeps = sweeps.where(q.where(events, **DROPS).where(F.col("src_ip").isNotNull()).exists())
    probers = persistent_prober(events, profile, sweep=limits).agg(F.count("*").alias("n"))
    return M.all_of(
        M.stats(
            back,
            [M.Stat("fw.conntrack_return", "n", "perimeter", "Conntrack-timeout return traffic")],
            2000,
        ),
        M.stats(sweeps, [M.Stat("fw.sweeps", "n", "perimeter", "Scanner sweeps")], 2001),
        M.stats(probers, [M.Stat("fw.probers", "n", "perimeter", "Persistent probers")], 2002),
    )


def stepped_ttl(
    events: DataFrame, *, max_low: int = 8, min_spread: int = 4, min_hits: int = 10
) -> DataFrame:
    """Dropped UDP whose TTL walks upward from a low value."""
    rows = q.source_profile(events, proto="udp", **DROPS).where(
        (F.col("ttl_min") <= max_low)
        & (F.col("ttl_max") - F.col("ttl_min") >= min_spread)
        & (F.col("hits") >= min_hits)
    )
    return as_signals(
        rows,
        signal_id=text("fw.stepped_ttl.", F.col("src_ip")),
        analyzer=PATTERNS,
        title=text("Stepped-TTL UDP probe from ", F.col("src_ip")),
        taxonomy="scan.stepped_ttl",
        severity=LOW,
        confidence=0.5,
        entities=F.array(entity("ip", "src_ip", "source")),
        evidence=["hits", "ttl_min", "ttl_max", "distinct_dst_ports", "duration_hours"],
    )


TRACE_TAXONOMY = "recon.internal_traceroute"


def cross_zone_ladders(events: DataFrame, profile: Profile, **limits) -> DataFrame:
    """TTL ladders between two internal hosts of different zones."""
    ladders = series.ttl_ladders(events, kind="firewall", **limits)
    zoned = ladders.withColumn("src_zone", profile.zone_of("src_ip")).withColumn(
        "dst_zone", profile.zone_of("dst_ip")
    )
    inside = (F.col("src_zone") != "external") & (F.col("dst_zone") != "external")
    return zoned.where(inside & (F.col("src_zone") != F.col("dst_zone")))


def internal_traceroute(
    events: DataFrame,
    profile: Profile,
    baseline: Baseline | None = None,
    *,
    mapping_min: int = 3,
    **limits,
) -> DataFrame:
    """Hosts tracing routes into other zones, one signal per source."""
    ladders = cross_zone_ladders(events, profile, **limits)
    order = Window.partitionBy("src_ip").orderBy(F.desc("probes"), "dst_ip", "proto")
    listed = (
        ladders.withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= 10)
        .groupBy("src_ip")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "_rank", "dst_ip", "dst_zone", "proto", "ttl_start",
                        (F.col("ttl_start") + F.col("hops") - 1).alias("ttl_end"),
                        "probes", "first_seen", "last_seen",
                    )
                )
            ).alias("destinations")
        )
    )
    trust = profile.trust_of("src_zone")
    known_trusted = ~profile.trust_of("dst_zone").isin(*UNTRUSTED, "unknown")
    groups = ladders.groupBy("src_ip", "src_zone").agg(
        F.count("*").alias("distinct_destinations"), F.bool_or(known_trusted).alias("_into")
    )
    rows = (
        groups.join(listed, "src_ip")
        .withColumn("source_trust", trust)
        .withColumn("into_more_trusted_zone", F.col("source_trust").isin(*UNTRUSTED) & F.col("_into"))
    )
    rows = with_recurrence(rows, baseline, TRACE_TAXONOMY, "src_ip")
    first = F.col("destinations")[0]["dst_ip"]
    target = F.when(
        F.col("distinct_destinations") > 1, text(F.col("distinct_destinations"), " hosts")
    ).otherwise(profile.label_for(first))
    serious = F.col("into_more_trusted_zone") | (F.col("distinct_destinations") >= mapping_min)
    named = F.transform(F.slice("destinations", 1, 5), lambda d: d["dst_ip"])
    return as_signals(
        rows,
        signal_id=text("recon.traceroute.", F.col("src_ip")),
        analyzer="traceroute",
        title=text(
            profile.label_for("src_ip"), " traced routes from ", F.col("src_zone"), " to ", target
        ),
        taxonomy=TRACE_TAXONOMY,
        severity=F.when(serious, MEDIUM).otherwise(LOW),
        confidence=0.8,
        entities=entities_of(
            F.array(entity("ip", "src_ip", "source")), entity_list("ip", named, "destination")
        ),
        evidence=[
            F.col("src_zone").alias("source_zone"), "source_trust", "into_more_trusted_zone",
            "destinations", "distinct_destinations", "prior_runs",
        ],
    )


def traceroute_metrics(events: DataFrame, profile: Profile, **limits) -> DataFrame:
    sources = cross_zone_ladders(events, profile, **limits).agg(
        F.count_distinct("src_ip").alias("n")
    )
    return M.stats(
        sources,
        [
            M.Stat(
                "recon.internal_traceroute_sources", "n", "segments",
                "Hosts tracing routes into other zones",
            )
        ],
        2500,
    )


def traceroute_support(events: DataFrame, profile: Profile, *, per_ladder: int = 10, **limits) -> DataFrame:
    """Rows behind each traceroute signal: a few record keys of its three largest ladders."""
    ladders = cross_zone_ladders(events, profile, **limits)
    order = Window.partitionBy("src_ip").orderBy(F.desc("probes"), "dst_ip", "proto")
    main = ladders.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= 3)
    main = materialize(main, "ladders")
    keys = main.select(
        F.col("src_ip").alias("_s"), F.col("dst_ip").alias("_d"), F.col("proto").alias("_p")
    )
    fw = q.where(events, kind="firewall")
    same = (
        (fw["src_ip"] == keys["_s"])
        & (fw["dst_ip"] == keys["_d"])
        & fw["proto"].eqNullSafe(keys["_p"])
    )
    hits = fw.join(keys, same, "left_semi").select("src_ip", "dst_ip", "proto", "dedup_key").distinct()
    pick = Window.partitionBy("src_ip", "dst_ip", "proto").orderBy("dedup_key")
    return (
        hits.withColumn("_r", F.row_number().over(pick))
        .where(F.col("_r") <= per_ladder)
        .select(text("recon.traceroute.", F.col("src_ip")).alias("signal_id"), "dedup_key")
    )
