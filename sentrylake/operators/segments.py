"""Per-zone statistics and detections."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentrylake.functions import domains
from sentrylake.functions.scalars import DAYPARTS, daypart, entity, entity_list
from sentrylake.operators import metrics as M
from sentrylake.operators import query as q
from sentrylake.operators.history import Baseline, before
from sentrylake.operators.signals import as_signals, entities_of, text
from sentrylake.profile import Profile
from sentrylake.schema import HIGH, LOW, MEDIUM, UNTRUSTED

ANALYZER = "segment_review"


def _zones(spark: SparkSession, profile: Profile) -> DataFrame:
    rows = [(i, z.name) for i, z in enumerate(profile.zones)]
    return spark.createDataFrame(rows, "zone_ord int, zone string")


def zone_activity(events: DataFrame, profile: Profile) -> DataFrame:
    """Lookups, traffic events, distinct clients and distinct hosts per configured zone.

    Every event becomes one row per end that lies in a zone (an event inside one zone counts once),
    rows collapse to one per zone and host, and zones only sum those: no distinct count, and a
    zone with most of the traffic is spread over its hosts.
    """
    dns = F.col("kind") == "dns"
    end = lambda zone, host, weight: F.struct(
        zone.alias("zone"), host.alias("host"), weight.alias("weight")
    )
    one, none = F.lit(1), F.lit(0)
    same = F.coalesce(F.col("src_zone") == F.col("dst_zone"), F.lit(False))
    source = end(
        F.col("src_zone"), F.when(dns, F.col("client_ip")).otherwise(F.col("src_ip")), one
    )
    target = end(
        F.when(~dns, F.col("dst_zone")), F.col("dst_ip"), F.when(same, none).otherwise(one)
    )
    per_host = (
        q.where(events, kind=["dns", "firewall"])
        .select("kind", F.explode(F.array(source, target)).alias("e"))
        .where(F.col("e.zone").isin(*[z.name for z in profile.zones]))
        .groupBy("e.zone", "kind", "e.host")
        .agg(F.sum("e.weight").alias("n"))
    )
    is_dns = F.col("kind") == "dns"
    known = F.col("host").isNotNull()
    found = per_host.groupBy("zone").agg(
        F.sum(F.when(is_dns, F.col("n"))).alias("dns"),
        F.sum(F.when(~is_dns, F.col("n"))).alias("fw"),
        F.count_if(is_dns & known).alias("dns_clients"),
        F.count_if(~is_dns & known).alias("fw_clients"),
    )
    return (
        _zones(events.sparkSession, profile)
        .join(found, "zone", "left")
        .na.fill(0, ["dns", "fw", "dns_clients", "fw_clients"])
    )


def zone_metrics(events: DataFrame, profile: Profile) -> DataFrame:
    """Four metrics per zone, in profile order."""
    names = {
        "dns": ": DNS queries",
        "fw": ": firewall events",
        "dns_clients": ": distinct DNS clients",
        "fw_clients": ": distinct firewall sources",
    }
    activity = zone_activity(events, profile)
    items = [
        F.struct(
            F.lit("segments").alias("section"),
            (F.lit(6000 + i) + F.col("zone_ord") * 4).alias("ord"),
            F.concat(F.lit("zone."), F.col("zone"), F.lit(f".{c}")).alias("key"),
            F.col(c).cast("double").alias("value_num"),
            F.lit(None).cast("string").alias("value_text"),
            F.lit(None).cast("string").alias("unit"),
            F.concat(F.col("zone"), F.lit(label)).alias("label"),
        )
        for i, (c, label) in enumerate(names.items())
    ]
    return activity.select(F.explode(F.array(*items)).alias("m")).select("m.*")


def unexpected_names(events: DataFrame, profile: Profile) -> DataFrame:
    """Names (``zone, domain, n``) a zone with an expected list resolved outside that list."""
    listed = [z for z in profile.zones if z.expected_egress_domains]
    expected = F.lit(False)
    for z in listed:
        expected = expected | (
            (F.col("zone") == z.name) & domains.under_any(F.col("domain"), z.egress_suffixes)
        )
    return (
        q.where(events, kind="dns", src_zone=[z.name for z in listed])
        .where(F.col("domain") != "")
        .groupBy(F.col("src_zone").alias("zone"), "domain")
        .agg(F.count("*").alias("n"))
        .where(~expected & ~profile.is_benign_domain("domain"))
    )


def unexpected_egress(events: DataFrame, profile: Profile, *, listed: int = 20) -> DataFrame:
    """One signal per zone that resolved names outside its expected set."""
    names = unexpected_names(events, profile)
    order = Window.partitionBy("zone").orderBy(F.desc("n"), "domain")
    shown = (
        names.withColumn("_r", F.row_number().over(order))
        .where(F.col("_r") <= listed)
        .groupBy("zone")
        .agg(F.sort_array(F.collect_list(F.struct("_r", "domain", "n"))).alias("unexpected"))
    )
    gateway = {z.name: z.gateway for z in profile.zones if z.gateway}
    from sentrylake.functions.scalars import lookup

    caveat = (
        profile.attribution_caveat(lookup(F.col("zone"), gateway)) if gateway else F.lit("")
    )
    rows = (
        names.groupBy("zone")
        .agg(F.count("*").alias("count"))
        .join(shown, "zone")
        .withColumn("trust", profile.trust_of("zone"))
    )
    first = F.transform(F.slice("unexpected", 1, 10), lambda s: s["domain"])
    return as_signals(
        rows,
        signal_id=text("zone.", F.col("zone"), ".unexpected_egress"),
        analyzer=ANALYZER,
        title=text(
            F.col("zone"), " resolved ", F.col("count"), " domains outside its expected set"
        ),
        taxonomy="segment.unexpected_egress",
        severity=F.when(F.col("trust").isin(*UNTRUSTED), MEDIUM).otherwise(LOW),
        confidence=0.6,
        entities=entity_list("domain", first),
        evidence=[
            "zone", "trust", "count",
            F.transform("unexpected", lambda s: s.dropFields("_r")).alias("unexpected"),
            caveat.alias("attribution_caveat"),
        ],
    )


def inbound_accepted(
    events: DataFrame, profile: Profile, baseline: Baseline | None = None
) -> DataFrame:
    """Accepted sessions from outside into a zone.

    Any such session counts in an untrusted zone; elsewhere only sources never seen before, which
    needs a baseline. Attack-surface ports are preferred when any was reached.
    """
    accepted = (
        q.where(
            events, kind="firewall", action="accept", dst_zone=[z.name for z in profile.zones]
        )
        .where(F.col("src_ip") != "")
        .groupBy(F.col("dst_zone").alias("zone"), "src_ip", "dst_port")
        .agg(F.count("*").alias("n"))
        .where(profile.is_external("src_ip"))
        .withColumn("trust", profile.trust_of("zone"))
    )
    open_zone = F.col("trust").isin(*UNTRUSTED)
    notable = accepted.where(open_zone).withColumn("novel_only", F.lit(False))
    if baseline is not None:
        guarded = accepted.where(~open_zone)
        fresh = baseline.novel(guarded.select(F.col("src_ip").alias("value")).distinct(), "ip")
        fresh = baseline.when_present(fresh).select(F.col("value").alias("src_ip"))
        guarded = guarded.join(fresh, "src_ip", "left_semi").withColumn("novel_only", F.lit(True))
        notable = notable.unionByName(guarded)
    watched = F.coalesce(F.col("dst_port").isin(*profile.policy.attack_surface_ports), F.lit(False))
    flagged = notable.withColumn("watched", watched)
    zones = flagged.groupBy("zone").agg(F.bool_or("watched").alias("any_watched"))
    kept = flagged.join(zones, "zone").where(F.col("watched") | ~F.col("any_watched"))
    order = Window.partitionBy("zone").orderBy(F.desc("n"), "src_ip", "dst_port")
    rows = (
        kept.withColumn("_r", F.row_number().over(order))
        .where(F.col("_r") <= 20)
        .groupBy("zone", "trust", "novel_only")
        .agg(F.sort_array(F.collect_list(F.struct("_r", "src_ip", "dst_port", "n"))).alias("accepted"))
    )
    first = F.slice("accepted", 1, 8)
    ports = F.filter(F.transform(first, lambda s: s["dst_port"]), lambda p: p != 0)
    return as_signals(
        rows,
        signal_id=text("zone.", F.col("zone"), ".inbound_accepted"),
        analyzer=ANALYZER,
        title=F.when(
            F.col("novel_only"), text("New external source accepted inbound into ", F.col("zone"))
        ).otherwise(text("Inbound external sessions accepted into ", F.col("zone"))),
        taxonomy="segment.inbound_accepted",
        severity=F.when(F.col("novel_only"), MEDIUM).otherwise(HIGH),
        confidence=F.when(F.col("novel_only"), 0.6).otherwise(0.8),
        entities=entities_of(
            entity_list("ip", F.transform(first, lambda s: s["src_ip"]), "source"),
            entity_list("port", ports, "destination"),
        ),
        evidence=[
            "zone", "trust", F.col("novel_only").alias("novel_sources_only"),
            F.transform("accepted", lambda s: s.dropFields("_r")).alias("accepted"),
        ],
    )


def zone_dayparts(events: DataFrame, profile: Profile) -> DataFrame:
    """Firewall events per zone and part of the site-local day, zeros included."""
    spark = events.sparkSession
    try:
        from zoneinfo import ZoneInfo

        timezone = ZoneInfo(profile.timezone).key
    except (ValueError, KeyError, OSError):
        timezone = "UTC"
    parts = spark.createDataFrame(
        [
            (i, z.name, j, d)
            for i, z in enumerate(profile.zones)
            for j, d in enumerate(DAYPARTS)
        ],
        "zone_ord int, zone string, part_ord int, daypart string",
    )
    per_hour = (
        q.where(events, kind="firewall")
        .select(
            F.date_trunc("hour", "ts").alias("hour"),
            F.explode(F.array_distinct(F.array("src_zone", "dst_zone"))).alias("zone"),
        )
        .where(F.col("zone").isin(*[z.name for z in profile.zones]))
        .groupBy("zone", "hour")
        .agg(F.count("*").alias("n"))
    )
    counts = per_hour.groupBy("zone", daypart("hour", timezone).alias("daypart")).agg(
        F.sum("n").alias("n")
    )
    return parts.join(counts, ["zone", "daypart"], "left").na.fill(0, ["n"])


def _daypart_key() -> Column:
    return F.concat(F.lit("zone."), F.col("zone"), F.lit(".daypart."), F.col("daypart"))


def zone_daypart_metrics(events: DataFrame, profile: Profile) -> DataFrame:
    return zone_dayparts(events, profile).select(
        F.lit("segments_time").alias("section"),
        (F.lit(6500) + F.col("zone_ord") * 4 + F.col("part_ord")).alias("ord"),
        _daypart_key().alias("key"),
        F.col("n").cast("double").alias("value_num"),
        F.lit(None).cast("string").alias("value_text"),
        F.lit(None).cast("string").alias("unit"),
        F.concat_ws(" ", "zone", "daypart", F.lit("firewall events")).alias("label"),
    )


def time_of_day_anomaly(
    events: DataFrame,
    profile: Profile,
    history: DataFrame,
    as_of: datetime | str,
    *,
    days: int = 30,
    min_history: int = 5,
    quiet_ceiling: float = 5.0,
    min_now: int = 20,
    multiple: float = 4.0,
) -> DataFrame:
    """A zone busy in a part of the day that its own metric history shows as quiet."""
    past = (
        history.where(
            (F.col("ts") >= before(as_of, days=days)) & F.col("value_num").isNotNull()
        )
        .groupBy("key")
        .agg(F.count("*").alias("points"), F.avg("value_num").alias("mean"))
        .where((F.col("points") >= min_history) & (F.col("mean") <= quiet_ceiling))
    )
    now = zone_dayparts(events, profile).withColumn("key", _daypart_key())
    rows = (
        now.join(past, "key")
        .where(
            (F.col("n") >= min_now)
            & (F.col("n") >= F.greatest(F.col("mean"), F.lit(1.0)) * multiple)
        )
        .withColumn("trust", profile.trust_of("zone"))
    )
    return as_signals(
        rows,
        signal_id=text("zone.", F.col("zone"), ".daypart_anomaly.", F.col("daypart")),
        analyzer=ANALYZER,
        title=text(
            F.col("zone"), " was active during its normally-quiet ", F.col("daypart"), " hours"
        ),
        taxonomy="segment.time_of_day_anomaly",
        severity=F.when(F.col("trust").isin(*UNTRUSTED), MEDIUM).otherwise(LOW),
        confidence=0.5,
        entities=F.array(entity("host", "zone", "segment")),
        evidence=[
            "zone", "daypart", F.col("n").alias("events_this_run"),
            F.col("mean").alias("historical_mean"), F.col("points").alias("history_days_observed"),
            F.lit(profile.timezone).alias("site_timezone"),
        ],
    )


def nat_notes(spark: SparkSession, profile: Profile) -> DataFrame:
    """One note per gateway behind which devices cannot be told apart."""
    gateways = [(g,) for g in profile.policy.nat_attribution_limited_behind]
    frame = spark.createDataFrame(gateways, "gateway string")
    return frame.withColumn("note", profile.attribution_caveat("gateway"))
