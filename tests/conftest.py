"""A local session and a planted day with known answers."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sentrylake.operators import history as H
from sentrylake.operators.history import Baseline
from sentrylake.profile import Profile
from sentrylake.schema import EVENT_SCHEMA, FINDING_SCHEMA, conform_events
from sentrylake.sources.common import assign_zones

START = "2026-05-31 12:00:00"
END = "2026-06-01 12:00:00"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", "file:" + str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def profile():
    return Profile.parse(
        {
            "zones": [
                {"name": "lan", "cidrs": ["10.10.0.0/24"], "trust": "trusted"},
                {
                    "name": "iot", "cidrs": ["10.10.50.0/24"], "trust": "untrusted",
                    "gateway": "10.10.0.8", "expected_egress_domains": ["vendor.example"],
                },
                {"name": "dmz", "cidrs": ["10.10.15.0/24"], "trust": "semi-trusted", "gateway": "10.10.0.2"},
            ],
            "hosts": [{"ip": "10.10.0.1", "name": "edge"}, {"ip": "10.10.0.69", "role": "resolver"}],
            "policy": {
                "approved_resolvers": ["10.10.0.69"],
                "attack_surface_ports": [22, 23, 445, 3389],
                "nat_attribution_limited_behind": ["10.10.0.8", "10.10.0.2"],
            },
        }
    )


def make_events(spark, rows, profile):
    """Events from dictionaries; ``ts`` as text."""
    columns = sorted({k for r in rows for k in r})
    types = {f.name: f.dataType.simpleString() for f in EVENT_SCHEMA.fields}
    types["ts"] = "string"
    frame = spark.createDataFrame(
        [tuple(r.get(c) for c in columns) for r in rows],
        ", ".join(f"`{c}` {types[c]}" for c in columns),
    )
    if "ts" in columns:
        frame = frame.withColumn("ts", F.col("ts").cast("timestamp"))
    events = conform_events(frame)
    return conform_events(assign_zones(events, profile))


@pytest.fixture(scope="session")
def planted(spark, profile):
    """Six patterns: a sweep, a prober, return traffic, ordinary lookups, a resolver bypass and a
    periodic check-in. 425 firewall and 572 DNS rows."""
    start = F.lit(START).cast("timestamp")
    i = F.col("id")

    def at(seconds):
        return F.timestamp_add("SECOND", seconds.cast("int"), start)

    base = {"kind": "firewall", "source": "syslog", "iface_in": "eth0", "action": "drop"}
    sweep = spark.range(40).select(
        at(i * 600).alias("ts"), F.concat(F.lit("198.51.100."), i + 1).alias("src_ip"),
        F.lit("192.0.2.9").alias("dst_ip"), (i * 7 + 1000).cast("int").alias("dst_port"),
        F.lit("tcp").alias("proto"), (i % 11 + 45).cast("int").alias("ttl"), F.lit(40000).alias("src_port"),
    )
    prober = spark.range(300).select(
        at(i * 96 + 7200).alias("ts"), F.lit("203.0.113.45").alias("src_ip"), F.lit("192.0.2.9").alias("dst_ip"),
        F.lit(22).alias("dst_port"), F.lit("tcp").alias("proto"), F.lit(51).alias("ttl"), (i + 30000).cast("int").alias("src_port"),
    )
    back = spark.range(60).select(
        at(i * 1200).alias("ts"), F.concat(F.lit("93.184.216."), i % 30 + 1).alias("src_ip"), F.lit("192.0.2.9").alias("dst_ip"),
        (i * 311 + 30000).cast("int").alias("dst_port"), F.lit("tcp").alias("proto"), F.lit(443).alias("src_port"), F.lit(55).alias("ttl"),
    )
    bypass = spark.range(25).select(
        at(i * 900).alias("ts"), F.lit("10.10.0.55").alias("src_ip"), F.lit("8.8.8.8").alias("dst_ip"),
        F.lit(53).alias("dst_port"), F.lit("udp").alias("proto"), F.lit("accept").alias("action"),
    )
    firewall = sweep.unionByName(prober).unionByName(back, allowMissingColumns=True)
    firewall = firewall.withColumn("action", F.lit("drop")).unionByName(bypass, allowMissingColumns=True)
    for name, value in base.items():
        if name != "action":
            firewall = firewall.withColumn(name, F.lit(value))
    names = F.array(*[F.lit(n) for n in ("www.example.org", "mail.example.org", "cdn.example.net", "api.example.net")])
    ordinary = spark.range(500).select(
        at(F.pmod(F.hash(i), F.lit(86000))).alias("ts"), F.concat(F.lit("10.10.0."), F.pmod(F.hash(i + 1000), F.lit(41)) + 20).alias("client_ip"),
        F.element_at(names, (F.pmod(F.hash(i + 2000), F.lit(4)) + 1).cast("int")).alias("domain"), (i % 5 == 0).alias("blocked"),
    )
    beacon = spark.range(72).select(
        at(i * 600).alias("ts"), F.lit("10.10.0.99").alias("client_ip"), F.lit("steady-checkin.example.net").alias("domain"), F.lit(False).alias("blocked"),
    )
    dns = ordinary.unionByName(beacon).withColumns(
        {"kind": F.lit("dns"), "source": F.lit("resolver"), "qtype": F.lit("A"),
         "block_reason": F.when(F.col("blocked"), "GRAVITY").otherwise("FORWARDED")}
    )
    events = conform_events(firewall).unionByName(conform_events(dns))
    events = events.withColumn("id", F.monotonically_increasing_id())
    events = events.withColumn("dedup_key", F.concat(F.lit("k:"), F.col("id").cast("string")))
    return conform_events(assign_zones(events, profile)).cache()


@pytest.fixture(scope="session")
def first_run(spark):
    """A baseline that knows nothing."""
    return empty_baseline(spark)


def empty_baseline(spark, known=None, prior=None, findings=None, watchlist=None, metrics=None):
    return Baseline(
        as_of=END,
        known=known if known is not None else spark.createDataFrame([], "etype string, value string, first_seen timestamp, last_seen timestamp, occurrences bigint"),
        prior=prior if prior is not None else spark.createDataFrame([], "key string, prior double"),
        findings=findings if findings is not None else spark.createDataFrame([], FINDING_SCHEMA),
        metrics=metrics if metrics is not None else spark.createDataFrame([], "run_id string, ts timestamp, key string, value_num double, value_text string"),
        watchlist=watchlist if watchlist is not None else spark.createDataFrame([], H.WATCH_SCHEMA),
    )
