"""Detectors on the planted day, on crafted events, and on nothing at all."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import START, empty_baseline, make_events
from sentrylake.operators import (
    cloud,
    correlate,
    logons,
    perimeter,
    periodic,
    population,
    reporting,
    resolver,
    segments,
    series,
    volume,
)
from sentrylake.operators import history as H
from sentrylake.operators import query as q
from sentrylake.operators.signals import distinct_lists, signal_rows
from sentrylake.plans.daily import DETECTORS, Context, run_metrics, run_signals
from sentrylake.schema import EVENT_SCHEMA


def test_totals(planted):
    kinds = {r.kind: r["count"] for r in planted.groupBy("kind").count().collect()}
    assert kinds == {"firewall": 425, "dns": 572}
    assert q.count(planted, kind="firewall", action="drop").head().n == 400
    assert q.return_traffic_count(planted, kind="firewall").head().n == 60


def test_unknown_filter_is_an_error(planted):
    with pytest.raises(KeyError):
        q.where(planted, nonsense=1)


def test_sweep_members_are_never_probers(planted, profile):
    sweeps = {s.prefix: s.severity_hint for s in perimeter.mass_sweep(planted).collect()}
    # The return traffic of 30 addresses in one /24 has the same shape.
    assert sweeps == {"198.51.100.0/24": 0, "93.184.216.0/24": 0}
    probers = perimeter.persistent_prober(planted, profile).collect()
    assert [(p.signal_id, p.top_port, p.severity_hint) for p in probers] == [("fw.prober.203.0.113.45.22", 22, 2)]
    assert probers[0].duration_hours == pytest.approx(7.97, abs=0.01)


def test_recurrence_is_attached(spark, planted, profile):
    entity = [("ip", "203.0.113.45", "source")]
    rows = [(f"run{i}", f"F{i}", "2026-05-30 00:00:00", "scan.persistent_prober", entity) for i in range(3)]
    findings = spark.createDataFrame(rows, "run_id string, finding_id string, ts string, taxonomy string, entities array<struct<type:string,value:string,role:string>>")
    findings = findings.withColumn("ts", F.col("ts").cast("timestamp"))
    found = perimeter.persistent_prober(planted, profile, empty_baseline(spark, findings=findings)).head()
    assert found.prior_runs == 3


def test_resolver_bypass_and_beacon(planted, profile):
    bypass = resolver.resolver_bypass(planted, profile).collect()
    assert len(bypass) == 1 and bypass[0].severity_hint == 3 and bypass[0].observed[0].n == 25
    beacons = periodic.dns_beacons(planted, profile).collect()
    assert [b.domain for b in beacons] == ["steady-checkin.example.net"]
    assert beacons[0].interval_seconds == 600.0 and beacons[0].cv == 0.0 and beacons[0].confidence == pytest.approx(0.95)


def test_beacon_scores_agree_with_a_loop(spark):
    rng = random.Random(3)
    start = datetime(2026, 6, 1)
    rows = []
    for s in range(30):
        t = start
        for _ in range(rng.randint(8, 60)):
            rows.append((f"s{s}", t))
            if rng.random() < 0.1:
                rows.append((f"s{s}", t))
            t += timedelta(seconds=rng.choice([600, 600, 610, 700, 2000 if s % 3 else 600]))
    frame = spark.createDataFrame(rows, "k string, ts timestamp")
    got = {r.k: r.cv for r in series.beacon_scores(frame, ["k"]).collect()}
    want = {}
    for s in {r[0] for r in rows}:
        stamps = sorted(r[1].timestamp() for r in rows if r[0] == s)
        gaps = [b - a for a, b in zip(stamps, stamps[1:]) if b > a]
        if len(stamps) < 12 or stamps[-1] - stamps[0] < 10800 or len(gaps) < 11:
            continue
        mean = sum(gaps) / len(gaps)
        cv = (sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** 0.5 / mean
        if 30 <= mean <= 7200 and cv <= 0.18:
            want[s] = cv
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_widest_window_agrees_with_a_loop(spark):
    rng = random.Random(11)
    base = datetime(2026, 6, 1, 23, 30)
    rows = [(f"m{rng.randint(0, 25)}", base + timedelta(seconds=rng.randint(0, 6000))) for _ in range(300)]
    got = series.widest_window(spark.createDataFrame(rows, "user string, ts timestamp"), "user").head()
    best, start = 0, None
    for end in sorted(r[1] for r in rows):
        inside = [r for r in rows if end - timedelta(seconds=300) <= r[1] <= end]
        if len({r[0] for r in inside}) > best:
            best, start = len({r[0] for r in inside}), min(r[1] for r in inside)
    assert got.distinct_members == best and got.window_start == start


def test_traceroute_into_a_more_trusted_zone(spark, profile):
    rows = [
        {"ts": f"2026-06-01 00:00:{t:02d}", "kind": "firewall", "source": "syslog", "src_ip": "10.10.50.9", "dst_ip": "10.10.0.20", "proto": "udp", "ttl": t, "action": "drop"}
        for t in (1, 2, 3, 4, 5)
    ]
    rows += [{**r, "src_ip": "10.10.0.30", "ttl": r["ttl"] + 40} for r in rows]
    found = perimeter.internal_traceroute(make_events(spark, rows, profile), profile).collect()
    assert [(f.source_zone, f.severity_hint, f.into_more_trusted_zone) for f in found] == [("iot", 2, True)]
    assert found[0].destinations[0].ttl_end == 5


def test_tunnel_and_payload_queries(spark, profile):
    rows = [
        {"ts": START, "kind": "dns", "source": "resolver", "client_ip": "10.10.0.30", "domain": f"c{i}.x.tunnel.test", "qtype": "TXT", "blocked": False}
        for i in range(60)
    ]
    rows += [{**rows[0], "domain": "pay.test"} for _ in range(25)]
    events = make_events(spark, rows, profile)
    fan = resolver.tunnel_suspect(events, profile).collect()
    assert [(f.apex, f.distinct_subdomains, f.confidence, len(f.sample_subdomains)) for f in fan] == [("tunnel.test", 60, 0.7, 10)]
    assert [t.domain for t in resolver.tunnel_qtype_suspect(events, profile).head().top] == ["pay.test"]


def test_novelty_needs_an_earlier_run(spark, planted, profile, first_run):
    assert resolver.novel_domain(planted, profile, first_run).count() == 0
    known = H.entities(H.observations(planted.where("domain != 'steady-checkin.example.net' or domain is null"), "run0", "2026-05-01 00:00:00"))
    prior = spark.createDataFrame([("fw.total", 1.0)], "key string, prior double")
    later = empty_baseline(spark, known=known, prior=prior)
    fresh = resolver.novel_domain(planted, profile, later).head()
    assert [t.value for t in fresh.top_novel] == ["steady-checkin.example.net"]
    clients = population.novel_client(planted, profile, later).collect()
    assert [(c.zone, c.ips) for c in clients] == [("lan", ["10.10.0.99"])]


def test_inbound_rules_differ_by_trust(spark, profile):
    row = {"ts": START, "kind": "firewall", "source": "syslog", "action": "accept", "src_ip": "203.0.113.9", "proto": "tcp", "dst_port": 8080}
    events = make_events(spark, [{**row, "dst_ip": "10.10.50.4"}, {**row, "dst_ip": "10.10.0.4"}, {**row, "dst_ip": "10.10.50.4", "dst_port": 22}], profile)
    first = segments.inbound_accepted(events, profile).collect()
    assert [(f.zone, f.severity_hint, [a.dst_port for a in f.accepted]) for f in first] == [("iot", 3, [22])]
    prior = spark.createDataFrame([("fw.total", 1.0)], "key string, prior double")
    later = segments.inbound_accepted(events, profile, empty_baseline(spark, prior=prior)).collect()
    assert {(f.zone, f.severity_hint) for f in later} == {("iot", 3), ("lan", 2)}


def test_volume_outlier_needs_peers(spark, profile):
    row = {"ts": START, "kind": "firewall", "source": "syslog", "action": "accept", "dst_ip": "203.0.113.9"}
    rows = [{**row, "src_ip": f"10.10.0.{20 + i}", "pkt_len": 1000} for i in range(3)] + [{**row, "src_ip": "10.10.0.99", "pkt_len": 1_000_000}]
    events = make_events(spark, rows, profile)
    assert [r.src for r in volume.volume_outlier(events, profile, floor_bytes=10_000).collect()] == ["10.10.0.99"]
    assert volume.volume_outlier(events.where("src_ip = '10.10.0.99'"), profile, floor_bytes=10_000).count() == 0


def test_watchlist_counts_both_ends(spark, profile):
    rows = [{"ts": START, "kind": "firewall", "source": "syslog", "src_ip": "10.10.0.5", "dst_ip": "10.10.0.5"}]
    watch = spark.createDataFrame([("ip", "10.10.0.5", "r", None, None), ("domain", "10.10.0.5", "r", None, None)], H.WATCH_SCHEMA)
    hits = correlate.watch_activity(make_events(spark, rows, profile), watch, START).collect()
    assert [(h.entity_type, h.n) for h in hits] == [("ip", 2)]


def test_cloud_bounded_lists(spark):
    rows = spark.range(100_000).select(F.lit("g").alias("k"), F.concat(F.lit("v"), F.lpad((F.col("id") % 5000).cast("string"), 4, "0")).alias("v"))
    got = distinct_lists(rows, ["k"], {"a": (F.col("v"), 3), "b": (F.array("v", F.lit("a")), 2)}).head()
    assert got.a == ["v0000", "v0001", "v0002"] and got.b == ["a", "v0000"]


@pytest.mark.parametrize("name", [d.name for d in DETECTORS])
def test_no_events_no_signals(spark, profile, first_run, name):
    detector = next(d for d in DETECTORS if d.name == name)
    nothing = spark.createDataFrame([], EVENT_SCHEMA)
    lists = spark.createDataFrame([], "value string, kind string, severity int, tier string, source string, campaign string, warning string, expires date, origin string")
    assert signal_rows(detector.run(Context(nothing, profile, first_run, lists))).count() == 0


def test_whole_run(spark, planted, profile):
    signals = run_signals(Context(planted, profile), ["mass_sweep", "persistent_prober", "resolver_bypass", "dns_beacons", "stepped_ttl"])
    assert {r.taxonomy for r in signals.select("taxonomy").distinct().collect()} == {
        "scan.mass_sweep", "scan.persistent_prober", "dns.resolver_bypass", "c2.beacon_candidate"
    }
    metrics = {r.key: r.value_num for r in run_metrics(Context(planted, profile)).collect()}
    assert metrics["fw.total"] == 425 and metrics["dns.total"] == 572 and metrics["fw.probers"] == 1 and metrics["fw.sweeps"] == 2
    assert metrics["beacon.candidates"] == 1 and metrics["fw.conntrack_return"] == 60 and metrics["zone.iot.dns"] == 0


def test_mass_deauth(spark, profile):
    rows = [{"ts": f"2026-06-01 10:0{i // 2}:00", "kind": "auth", "source": "syslog", "action": "deauth", "user": f"02:00:00:00:00:0{i}"} for i in range(7)]
    found = logons.mass_deauth_burst(make_events(spark, rows, profile)).collect()
    assert [(f.signal_id, f.distinct_devices) for f in found] == [("auth.mass_deauth.20260601T100000", 7)]


def test_console_logins(spark):
    raw = "struct<principal_type:string,mfa:string>"
    rows = [("1", "aws_login_ok", "u1", ("IAMUser", "No")), ("2", "aws_login_ok", "u2", ("AssumedRole", "No")), ("3", "aws_login_ok", "u3", ("Root", "Yes"))]
    frame = spark.createDataFrame([(START, a, u, r) for _, a, u, r in rows], f"ts string, action string, user string, raw {raw}")
    from sentrylake.plans.tables import _wrap_raw
    from sentrylake.schema import conform_events

    events = conform_events(_wrap_raw(frame.withColumnRenamed("raw", "_raw").withColumns(
        {"ts": F.col("ts").cast("timestamp"), "kind": F.lit("auth"), "source": F.lit("aws_cloudtrail")})))
    assert [r.user for r in cloud.console_login_no_mfa(events).collect()] == ["u1"]


def test_a_failing_detector_leaves_the_others(spark, planted, profile, monkeypatch):
    from sentrylake.plans import daily

    context = daily.Context(planted, profile)
    names = [d.name for d in daily.DETECTORS if not d.needs_baseline and not d.needs_indicators][:4]
    want = sorted(r.signal_id for r in daily.run_signals(context, names).collect())

    def raises(context):
        raise KeyError("no such column")

    first = next(d for d in daily.DETECTORS if d.name in names and d.run(context).count())
    late = lambda c: first.run(c).withColumn("title", F.raise_error(F.lit("broken late")).cast("string"))
    broken = [daily.Detector("early", raises, frozenset()), daily.Detector("late", late, frozenset())]
    monkeypatch.setattr(daily, "DETECTORS", [*daily.DETECTORS, *broken])
    signals, failed = daily.run_guarded(context, [*names, "early", "late"])
    assert sorted(r.signal_id for r in signals.collect()) == want
    errors = {r.detector: r.error for r in failed.collect()}
    assert "no such column" in errors["early"] and "broken late" in errors["late"] and len(errors) == 2
    signals, failed = daily.run_guarded(context, [])
    assert signals.count() == failed.count() == 0


def test_limits_can_be_taken_off(spark, profile):
    from sentrylake.operators import reporting
    from sentrylake.sources import sinks

    events = make_events(spark, [{"ts": START, "source": "syslog", "kind": "firewall", "action": "drop", "src_ip": "10.0.0.1", "dedup_key": f"k{i}"} for i in range(1203)], profile)
    keys = events.select("dedup_key")
    assert [q.get_events(events, n).count() for n in (None, 0, 500)] == [1203, 1, 200]
    assert (q.sample_by_dedup(events, keys, None).count(), q.sample_by_dedup(events, keys).count()) == (1203, 20)
    sinks.register_views(spark, {"all_keys": keys}, "r")
    assert [sinks.run_sql(spark, "select * from all_keys", n).count() for n in (None, 5000, 7)] == [1203, 1000, 7]
    signals = spark.range(90).selectExpr("cast(id as string) as signal_id", "1 as severity_hint", "0.5D as confidence")
    assert (reporting.rank_signals(signals, None).count(), reporting.rank_signals(signals).count()) == (90, 60)


@pytest.mark.parametrize("n, ranks", [(2, [1, 2]), (None, [1, 2, 3, 4])])
def test_samples_of_signals(spark, profile, n, ranks):
    rows = [{"ts": f"2026-06-01 00:00:0{i}", "kind": "firewall", "source": "syslog", "src_ip": "10.10.0.9", "dedup_key": f"k{i}"} for i in range(4)]
    events = make_events(spark, rows, profile)
    signals = spark.sql("select 'a' signal_id, array(named_struct('type', 'ip', 'value', '10.10.0.9', 'role', 'source')) entities union all select 'b', array()")
    support = spark.createDataFrame([("b", "k1")], "signal_id string, dedup_key string")
    got = reporting.signal_samples(signals, events, support, n).collect()
    assert sorted((r["rank"], r.dedup_key) for r in got if r.signal_id == "a") == [(r, f"k{4 - r}") for r in ranks]
    assert [(r["rank"], r.dedup_key, r.field) for r in got if r.signal_id == "b"] == [(1, "k1", "dedup_key")]
