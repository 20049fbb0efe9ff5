"""Source health and self-test: did the data arrive, and do the detectors notice what they must."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrylake.functions.scalars import dedup_key
from sentrylake.operators import query as q
from sentrylake.schema import CANARY_SOURCE, conform_events

# Tolerances of the integrity gates.
COUNT_TOLERANCE = 0.02
SPAN_TOLERANCE = 0.15

PROBE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("ok", T.BooleanType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("records", T.LongType()),
    ]
)

# What a collector leaves beside the landed files of a source.
MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("requested_start", T.TimestampType()),
        T.StructField("requested_end", T.TimestampType()),
        T.StructField("effective_start", T.TimestampType()),
        T.StructField("reported_total", T.LongType()),
        T.StructField("pages", T.IntegerType()),
        T.StructField("complete", T.BooleanType()),
        T.StructField("activity_driven", T.BooleanType()),
        T.StructField("min_expected", T.LongType()),
        T.StructField("errors", T.ArrayType(T.StringType())),
        T.StructField("probes", T.ArrayType(PROBE)),
    ]
)


def collection_stats(events: DataFrame) -> DataFrame:
    """Records, distinct records and time span per source.

    Keys collapse to one row each before they are counted, so that a page collected many times is
    combined where it was read.
    """
    keys = events.groupBy("source", "dedup_key").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    return keys.groupBy("source").agg(
        F.sum("n").alias("records"),
        F.count("*").alias("unique_records"),
        q.hours_between(F.min("first_ts"), F.max("last_ts")).alias("span_hours"),
    )


def probes_prove_failure(probes: Column) -> Column:
    """True when probes ran, none returned data, and none failed for lack of credentials."""
    returned = F.exists(probes, lambda p: p["ok"] & (F.coalesce(p["records"], F.lit(0)) > 0))
    refused = F.exists(probes, lambda p: F.coalesce(p["status"], F.lit(0)) == 401)
    silent = F.forall(probes, lambda p: F.coalesce(p["records"], F.lit(0)) == 0)
    return (F.size(probes) > 0) & ~returned & ~refused & silent


def classify_health(stats: DataFrame, manifest: DataFrame) -> DataFrame:
    """State of every source: OK, DEGRADED, SUSPECT or FAILED, with the reasons."""
    hours = q.hours_between
    rows = (
        manifest.join(stats, "source", "left")
        .na.fill({"records": 0, "unique_records": 0, "span_hours": 0.0})
        .withColumn("requested_hours", hours("requested_start", "requested_end"))
        .withColumn("effective_hours", hours("effective_start", "requested_end"))
        .withColumn("clamped", F.col("effective_hours") < F.col("requested_hours") - 0.01)
    )
    empty_list = F.array().cast("array<string>")
    errors = F.coalesce(F.col("errors"), empty_list)
    probes = F.coalesce(F.col("probes"), F.array().cast(T.ArrayType(PROBE)))
    missing = F.col("reported_total") - F.col("unique_records")
    short = (F.col("reported_total") > 0) & (missing > F.col("reported_total") * COUNT_TOLERANCE)
    truncated = (
        ~F.col("activity_driven")
        & (F.col("effective_hours") > 0)
        & (F.col("span_hours") < F.col("effective_hours") * (1 - SPAN_TOLERANCE))
    )
    problems = F.array_compact(
        F.array(
            F.when(short, F.lit("incomplete pull")),
            F.when(F.col("records") != F.col("unique_records"), F.lit("duplicated pages")),
            F.when(~F.col("complete"), F.lit("pagination did not complete")),
            F.when(truncated, F.lit("truncated time span")),
            F.when(
                (F.col("min_expected") > 0) & (F.col("records") < F.col("min_expected")),
                F.lit("below the expected floor"),
            ),
        )
    )
    quiet = (
        F.col("activity_driven")
        & (F.size(errors) == 0)
        & (F.size(probes) > 0)
        & F.forall(probes, lambda p: p["ok"])
    )
    none = F.col("records") == 0
    state = (
        F.when(none & quiet, "OK")
        .when(none & probes_prove_failure(probes), "FAILED")
        .when(none, "SUSPECT")
        .when((F.size(problems) > 0) | F.col("clamped") | (F.size(errors) > 0), "DEGRADED")
        .otherwise("OK")
    )
    notes = (
        F.when(none & quiet, F.array(F.lit("quiet period: every probe passed")))
        .when(none & probes_prove_failure(probes), F.array(F.lit("no records and no probe answered")))
        .when(none, F.array(F.lit("no records, cause not established")))
        .otherwise(problems)
    )
    clamped = F.when(F.col("clamped"), F.array(F.lit("window clamped by retention")))
    return rows.select(
        "source",
        state.alias("state"),
        "records",
        "unique_records",
        "reported_total",
        "span_hours",
        "requested_hours",
        "pages",
        F.concat(
            F.transform(errors, lambda e: F.concat(F.lit("error: "), e)),
            F.coalesce(clamped, empty_list),
            notes,
        ).alias("notes"),
    ).withColumn("usable", F.col("state").isin("OK", "DEGRADED"))


def dns_block_rate(events: DataFrame) -> DataFrame:
    """Block rate per DNS source, for the health notes."""
    return (
        q.where(events, kind="dns")
        .groupBy("source")
        .agg(
            F.count("*").alias("records"),
            F.count_if(F.col("blocked") == F.lit(True)).alias("blocked"),
        )
        .withColumn("block_rate_pct", 100.0 * F.col("blocked") / F.col("records"))
    )


def emergency_breakdown(events: DataFrame, n: int = 5) -> DataFrame:
    """Programs that log at the highest severity, which is often mislabelled chatter."""
    return (
        q.where(events, severity="emerg")
        .groupBy(F.coalesce("program", F.lit("?")).alias("program"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "program")
        .limit(n)
    )


def device_records(events: DataFrame, reported: DataFrame) -> DataFrame:
    """Records per device beside what its log server reported; devices without any are flagged.

    ``reported`` has ``device, reported`` and optionally ``hostname, ip``.
    """
    got = events.where(F.col("device").isNotNull()).groupBy("device").agg(F.count("*").alias("records"))
    names = [F.nullif(F.col(c), F.lit("")) for c in ("hostname", "ip") if c in reported.columns]
    return (
        reported.join(got, "device", "left")
        .withColumn("records", F.coalesce(F.col("records"), F.lit(0)))
        .withColumn("zero_records", F.col("records") == 0)
        .withColumn("label", F.coalesce(*names, F.col("device")))
    )


# ----- planted self-test events

# Documentation addresses and a reserved name, never routable and never real.
CANARY_SRC = "192.0.2.77"
CANARY_CLIENT = "198.51.100.42"
CANARY_DST = "203.0.113.199"
CANARY_DOMAIN = "sentrylake-canary-beacon.invalid"
BEACON_SAMPLES = 60
BEACON_INTERVAL_S = 300
PROBER_HITS = 400
PROBER_PORT = 22
PROBER_HOURS = 6

# What each planted pattern must be reported as, and the entities that identify it.
CANARIES = (
    ("dns_beacon", "dns", "c2.beacon_candidate", (CANARY_DOMAIN, CANARY_CLIENT)),
    ("persistent_prober", "firewall", "scan.persistent_prober", (CANARY_SRC, str(PROBER_PORT))),
)


def canary_events(
    spark: SparkSession, start: datetime, end: datetime, kinds: tuple[str, ...] = ("dns", "firewall")
) -> DataFrame:
    """Planted events inside a window: a perfectly periodic lookup and a textbook prober."""
    start_us, end_us = _micros(start), _micros(end)
    beacon_start = max(start_us, end_us - (BEACON_INTERVAL_S * BEACON_SAMPLES + 300) * 1_000_000)
    span = min(PROBER_HOURS * 3_600_000_000, end_us - start_us)
    step = span // PROBER_HITS
    i = F.col("id")
    beacon = spark.range(BEACON_SAMPLES).select(
        F.timestamp_micros(F.lit(beacon_start) + i * BEACON_INTERVAL_S * 1_000_000).alias("ts"),
        F.lit("dns").alias("kind"),
        dedup_key(CANARY_SOURCE, F.lit("beacon"), i).alias("dedup_key"),
        F.lit(CANARY_DOMAIN).alias("domain"),
        F.lit("A").alias("qtype"),
        F.lit(False).alias("blocked"),
        F.lit(CANARY_CLIENT).alias("client_ip"),
    )
    prober = spark.range(PROBER_HITS).select(
        F.timestamp_micros(F.lit(end_us - span) + i * step).alias("ts"),
        F.lit("firewall").alias("kind"),
        dedup_key(CANARY_SOURCE, F.lit("prober"), i).alias("dedup_key"),
        F.lit(CANARY_SRC).alias("src_ip"),
        F.lit(CANARY_DST).alias("dst_ip"),
        (F.lit(40000) + i % 5000).cast("int").alias("src_port"),
        F.lit(PROBER_PORT).alias("dst_port"),
        F.lit("tcp").alias("proto"),
        F.lit("drop").alias("action"),
        F.lit("canary0").alias("iface_in"),
        F.lit(52).alias("ttl"),
        F.lit(60).alias("pkt_len"),
    )
    both = beacon.unionByName(prober, allowMissingColumns=True)
    planted = both.where(F.col("kind").isin(*kinds) & (F.col("ts") < F.timestamp_micros(F.lit(end_us))))
    return conform_events(
        planted.withColumns(
            {"source": F.lit(CANARY_SOURCE), "message": F.lit("synthetic canary event")}
        )
    )


def _micros(moment: datetime) -> int:
    epoch = datetime(1970, 1, 1, tzinfo=moment.tzinfo)
    return (moment - epoch) // timedelta(microseconds=1)


def verify_canaries(signals: DataFrame, kinds: tuple[str, ...] = ("dns", "firewall")) -> DataFrame:
    """Whether each planted pattern was reported as expected and names one of its entities.

    ``signals`` come from detectors that ran on planted events alone.
    """
    spark = signals.sparkSession
    expected = spark.createDataFrame(
        [(n, t, list(e)) for n, k, t, e in CANARIES if k in kinds],
        "canary string, expect_taxonomy string, tokens array<string>",
    )
    named = signals.select("taxonomy", F.transform("entities", lambda e: e["value"]).alias("names"))
    hits = (
        expected.join(named, expected["expect_taxonomy"] == named["taxonomy"])
        .where(F.arrays_overlap("tokens", "names"))
        .groupBy("canary")
        .agg(F.count("*").alias("signals"))
    )
    return (
        expected.join(hits, "canary", "left")
        .withColumn("detected", F.col("signals").isNotNull())
        .select("canary", "expect_taxonomy", "detected")
    )


def mark_canary_signals(signals: DataFrame, tokens: tuple[str, ...] | None = None) -> DataFrame:
    """Flag signals that name a planted entity, so that they are never reported."""
    names = tokens or tuple(t for _, _, _, ts in CANARIES for t in ts)
    mine = F.arrays_overlap(
        F.transform("entities", lambda e: e["value"]), F.array(*[F.lit(n) for n in names])
    )
    already = F.col("is_canary") if "is_canary" in signals.columns else F.lit(False)
    return signals.withColumn("is_canary", F.coalesce(already | mine, F.lit(False)))
