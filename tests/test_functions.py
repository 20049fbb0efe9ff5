"""Scalar expressions against plain Python and known tables."""

from __future__ import annotations

import ipaddress
import math

from pyspark.sql import functions as F

from sentrylake.functions import domains, net, scalars
from sentrylake.operators import match
from sentrylake.operators.series import ladder_length
from sentrylake.sources import lists

ADDRESSES = [
    "::", "::1", "fe80::1", "fe80::1%eth0", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8",
    "1:2::4:5:6:7:8:9", "1::3:4:5:6:7:8", "1:::2", "1::2::3", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "::ffff:1.2.3.4",
    "::ffff:10.0.0.1", "::1.2.3.256", "2001:DB8::1", "fd00:10::5", "12345::1", "g::1", "2606:4700::1111", "64:ff9b::1.2.3.4",
    "2001:20::1", "2001:3::1", "100::1", "1.2.3.4", "01.2.3.4", "256.1.1.1", "10.0.0.1", "100.64.0.1", "192.0.0.9",
    "192.0.0.8", "198.18.0.1", "198.20.0.1", "255.255.255.255", "", "x", "1.2.3", "172.31.255.255", "172.32.0.0",
]


def parse(text):
    try:
        return ipaddress.ip_address(text)
    except ValueError:
        return None


def test_addresses_agree_with_the_standard_library(spark):
    frame = spark.createDataFrame([(a,) for a in ADDRESSES], "ip string").select(
        "ip", net.ip_hex("ip").alias("key"), net.is_private_address("ip").alias("private"),
        net.is_routable("ip").alias("routable"),
    )
    for row in frame.collect():
        a = parse(row.ip)
        want = (None, False, False) if a is None else (f"{int(a):0{a.max_prefixlen // 4}x}", a.is_private, a.is_global)
        assert (row.key, row.private, row.routable) == want, row.ip


def test_canonical_text_agrees_with_the_standard_library(spark):
    plain = [a for a in ADDRESSES if "%" not in a and "ffff:" not in a]
    frame = spark.createDataFrame([(a,) for a in plain], "ip string").select("ip", lists.canonical_ip("ip").alias("c"))
    for row in frame.collect():
        a = parse(row.ip)
        assert row.c == (None if a is None else str(a)), row.ip


def test_zones_take_the_first_match(spark, profile):
    cases = {
        "10.10.0.5": "lan", "10.10.50.200": "iot", "10.10.15.1": "dmz", "10.99.0.1": "private", "127.0.0.1": "private",
        "fd12::1": "private", "8.8.8.8": "external", "198.51.100.1": "external", "2606:4700::1": "external", "junk": None, None: None,
    }
    frame = spark.createDataFrame([(a,) for a in cases], "ip string").select("ip", profile.zone_of("ip").alias("z"))
    assert {r.ip: r.z for r in frame.collect()} == cases


def test_network_matching_agrees_with_brute_force(spark):
    ips = [f"{a}.{b}.{c}.{d}" for a in (10, 198) for b in (0, 51) for c in (0, 100, 101) for d in (1, 127, 128, 255)]
    ips += ["2001:db8::1", "2001:db8:1::1", "2001:dead::1"]
    nets = ["10.0.0.0/8", "198.51.0.0/16", "198.51.100.0/25", "198.51.100.128/31", "10.51.101.1/32", "2001:db8::/33", "2001:db8:1::/48"]
    known = spark.createDataFrame([(n, "cidr") for n in nets], "value string, kind string")
    values = spark.createDataFrame([(i,) for i in ips], "value string")
    got = {(r.value, r.indicator) for r in match.match_networks(values, known).collect()}
    want = {
        (i, n) for i in ips for n in nets
        if ipaddress.ip_address(i).version == ipaddress.ip_network(n).version and ipaddress.ip_address(i) in ipaddress.ip_network(n)
    }
    assert got == want


def test_domains(spark):
    apex = {
        "a.b.example.com": "example.com", "shop.foo.co.uk": "foo.co.uk", "co.uk": "co.uk", "localhost": "localhost",
        "x.y.com.au.": "y.com.au", "example.com": "example.com",
    }
    frame = spark.createDataFrame([(d,) for d in apex], "d string").select("d", domains.apex_domain("d").alias("a"))
    assert {r.d: r.a for r in frame.collect()} == apex
    generated = {
        "xk3jq9zv7w2m1p.example.com": True, "documentation.example.com": False, "short.example.com": False,
        "xk3jq9zv7w2m1p": False, "aaaaaaaaaaaaaaaa.example.com": False,
    }
    frame = spark.createDataFrame([(d,) for d in generated], "d string").select("d", domains.looks_generated("d").alias("g"))
    assert {r.d: r.g for r in frame.collect()} == generated
    label = "xk3jq9zv7w2m1p"
    entropy = -sum(label.count(c) / len(label) * math.log2(label.count(c) / len(label)) for c in set(label))
    got = spark.createDataFrame([(label,), ("",)], "s string").select(domains.shannon_entropy("s")).collect()
    assert math.isclose(got[0][0], entropy) and got[1][0] == 0.0


def test_ladder_length(spark):
    cases = [([1, 2, 3, 4], 4), ([1, 2, 4, 5], 2), ([4, 5, 6], 0), ([3, 4, 5, 9], 3), ([2], 1)]
    frame = spark.createDataFrame([(c,) for c, _ in cases], "t array<int>").select(ladder_length(F.col("t")).alias("n"))
    assert [r.n for r in frame.collect()] == [n for _, n in cases]


def test_small_scalars(spark):
    row = spark.range(1).select(
        scalars.human_interval(F.lit(45.0)).alias("a"), scalars.human_interval(F.lit(600.0)).alias("b"),
        scalars.human_interval(F.lit(7200.0)).alias("c"), scalars.delta_pct(F.lit(5), F.lit(0)).alias("d"),
        scalars.delta_pct(F.lit(5), F.lit(-10)).alias("e"), scalars.is_allowed_action(F.lit(None).cast("string")).alias("f"),
        scalars.ip_verdict(F.lit(None).cast("int"), F.lit(False)).alias("g"), scalars.parse_severity(F.lit("9")).alias("h"),
        scalars.normalize_protocol(F.lit("17")).alias("i"), scalars.syslog_severity(F.lit("0")).alias("j"),
    ).head()
    assert tuple(row) == ("45s", "10.0min", "2.0h", None, 150.0, True, "unknown", 4, "udp", "emerg")
