"""Run tables, history, health, review and streams."""

from __future__ import annotations

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from conftest import END, START, make_events
from sentrylake.operators import history as H
from sentrylake.operators import quality, review
from sentrylake.plans.daily import Context, run_canary_signals, run_metrics, run_signals
from sentrylake.session import scratch_path
from sentrylake.sources import sinks
from sentrylake.streaming import jobs
from sentrylake.streaming.batches import BatchTable

UTC = timezone.utc


def test_two_runs_through_the_tables(spark, planted, profile):
    root = scratch_path(spark, "store")
    for run, day in (("run1", "2026-05-31"), ("run2", "2026-06-01")):
        sinks.append_events(planted, root, run)
        sinks.append_events(planted, root, run)
        sinks.save_slice(H.build_ioc_dns(planted, run, day), root, "ioc_dns")
    events = sinks.read_events(spark, root)
    assert {r.run_id: r["count"] for r in events.groupBy("run_id").count().collect()} == {"run1": 997, "run2": 997}
    assert events.where("kind = 'dns' and run_id = 'run1'").count() == 572
    sinks.save_metrics(run_metrics(Context(events.where("run_id = 'run1'"), profile)), root, "run1", END)
    runs = spark.createDataFrame(
        [("run1", "2026-05-01 00:00:00", "2026-05-01 00:10:00"), ("run2", "2026-06-01 00:00:00", None)], "run_id string, started_at string, finished_at string"
    ).select("run_id", *[F.col(c).cast("timestamp").alias(c) for c in ("started_at", "finished_at")])
    prior = {r.key: r.prior for r in H.prior_metrics(runs, spark.read.parquet(sinks.table_path(root, "metrics")), "run2").collect()}
    assert prior["fw.total"] == 425
    hunted = H.hunt_domain(spark.read.parquet(sinks.table_path(root, "ioc_dns")), "CHECKIN", END).collect()
    assert [(r.queries, r.client_ip) for r in hunted] == [(72, "10.10.0.99")] * 2
    with pytest.raises(sinks.RunDeletionError):
        sinks.delete_run(spark, root, runs, "nope")
    with pytest.raises(sinks.RunDeletionError):
        sinks.delete_run(spark, root, runs, "run2")
    assert sinks.delete_run(spark, root, runs, "run2", force=True) == {"events": 1, "ioc_dns": 1}
    assert sinks.purge(spark, root, runs, datetime(2026, 6, 1)) == {"events": 1}
    assert sinks.purge(spark, root, runs, datetime(2027, 6, 1)) == {"ioc_dns": 2}


def test_entities_keep_account_and_device_apart(spark, profile):
    row = {"ts": START, "source": "syslog"}
    events = make_events(spark, [
        {**row, "kind": "auth", "action": "ssh_accepted", "user": "bob", "src_ip": "10.10.0.5"},
        {**row, "kind": "auth", "action": "deauth", "user": "02:00:00:00:00:01"},
        {**row, "kind": "firewall", "src_ip": "10.10.0.5", "dst_ip": "8.8.8.8"},
        {**row, "kind": "dns", "client_ip": "10.10.0.6", "domain": "A.example"},
    ], profile)
    assert {(r.etype, r.value, r.n) for r in H.entity_pairs(events).collect()} == {
        ("user", "bob", 1), ("ip", "10.10.0.5", 2), ("device", "02:00:00:00:00:01", 1), ("ip", "10.10.0.6", 1), ("domain", "a.example", 1)
    }


def test_novelty_grace(spark):
    known = spark.createDataFrame([("ip", "old", "2026-06-01 10:30:00"), ("ip", "fresh", "2026-06-01 11:30:00")], "etype string, value string, first_seen string")
    known = known.withColumn("first_seen", F.col("first_seen").cast("timestamp"))
    values = spark.createDataFrame([("old",), ("fresh",), ("never",)], "value string")
    assert {r.value for r in H.novel(values, known, "ip", END).collect()} == {"fresh", "never"}


def test_watchlist_updates(spark):
    old = spark.createDataFrame([("ip", "a", "old", None, None), ("ip", "b", "gone", None, datetime(2020, 1, 1))], H.WATCH_SCHEMA)
    updates = spark.createDataFrame([("ip", "a", "new", 0)], "entity_type string, entity_value string, reason string, expires_days int")
    active = H.active_watchlist(H.add_watch(old, updates, END), END).collect()
    assert [(w.entity_value, w.reason, w.expires_at) for w in active] == [("a", "new", datetime(2026, 6, 2, 12))]


def manifest(spark, **over):
    row = {
        "source": "s", "requested_start": datetime(2026, 6, 1), "requested_end": datetime(2026, 6, 2), "effective_start": datetime(2026, 6, 1), "reported_total": None,
        "pages": 1, "complete": True, "activity_driven": False, "min_expected": 0, "errors": [], "probes": [],
    }
    return spark.createDataFrame([tuple({**row, **over}.values())], quality.MANIFEST_SCHEMA)


@pytest.mark.parametrize(("over", "stats", "state"), [
    ({}, ("s", 100, 100, 24.0), "OK"),
    ({"reported_total": 200}, ("s", 100, 100, 24.0), "DEGRADED"),
    ({"reported_total": 101}, ("s", 100, 100, 24.0), "OK"),
    ({}, ("s", 100, 90, 24.0), "DEGRADED"),
    ({}, ("s", 100, 100, 12.0), "DEGRADED"),
    ({"activity_driven": True}, ("s", 100, 100, 12.0), "OK"),
    ({"effective_start": datetime(2026, 6, 1, 12)}, ("s", 100, 100, 12.0), "DEGRADED"),
    ({}, None, "SUSPECT"),
    ({"probes": [("p", True, 200, 0)]}, None, "FAILED"),
    ({"probes": [("p", True, 200, 5)]}, None, "SUSPECT"),
    ({"probes": [("p", False, 401, None)]}, None, "SUSPECT"),
    ({"activity_driven": True, "probes": [("p", True, 200, 0)]}, None, "OK"),
])
def test_health(spark, over, stats, state):
    rows = spark.createDataFrame([stats] if stats else [], "source string, records bigint, unique_records bigint, span_hours double")
    assert quality.classify_health(rows, manifest(spark, **over)).head().state == state


def test_planted_events_are_noticed_and_kept_out(spark, planted, profile):
    extra = quality.canary_events(spark, datetime(2026, 5, 31, 12, tzinfo=UTC), datetime(2026, 6, 1, 12, tzinfo=UTC))
    both = Context(planted.unionByName(extra), profile)
    names = ["dns_beacons", "persistent_prober"]
    results = quality.verify_canaries(run_canary_signals(both, names)).collect()
    assert all(r.detected for r in results) and len(results) == 2
    real = run_signals(both, names)
    assert real.count() == 2
    # The probed port is one of the tokens, so a real prober of that port is flagged as well;
    # addresses alone keep the two apart.
    assert quality.mark_canary_signals(real).where("is_canary").count() == 1
    assert quality.mark_canary_signals(real, (quality.CANARY_SRC, quality.CANARY_DOMAIN)).where("is_canary").count() == 0
    blind = quality.verify_canaries(run_canary_signals(both, ["dns_beacons"])).collect()
    assert {r.canary: r.detected for r in blind} == {"dns_beacon": True, "persistent_prober": False}


SUBMITTED = (
    "idx bigint, title string, severity string, confidence string, taxonomy string, zone string, signal_ids array<string>, event_ids array<string>, "
    "evidence_kinds array<string>, entities array<struct<type:string,value:string,role:string>>, what string, why string, not_this string, action string"
)


def submit(spark, **over):
    row = dict.fromkeys([c.split()[0] for c in SUBMITTED.split(", ")])
    row.update({"idx": 1, "title": "T", "severity": "HIGH", "signal_ids": ["s1"], **over})
    return spark.createDataFrame([tuple(row.values())], SUBMITTED)


@pytest.mark.parametrize(("over", "rejected", "severity"), [
    ({}, None, 3),
    ({"title": "  "}, "no title", None),
    ({"signal_ids": ["zz"]}, "cites no known signal or event", None),
    ({"evidence_kinds": ["reputation"]}, "no local evidence", None),
    ({"severity": "CRITICAL"}, None, 3),
    ({"severity": "SUSPECTED"}, None, 2),
    ({"severity": "bogus"}, None, 0),
    ({"signal_ids": [], "event_ids": ["0", "x", "999999999999"]}, None, -1),
    ({"signal_ids": ["s3"], "severity": "CRITICAL", "evidence_kinds": ["reputation", "baseline_delta"]}, None, 3),
    ({"signal_ids": ["s3"], "severity": "CRITICAL", "evidence_kinds": ["reputation", "correlation"]}, None, 4),
])
def test_review_rules(spark, planted, profile, over, rejected, severity):
    signals = spark.createDataFrame(
        [("s1", "a.b", 2, [("ip", "10.10.0.8", "source")]), ("s3", "c.d", 3, [])], "signal_id string, taxonomy string, severity_hint int, entities array<struct<type:string,value:string,role:string>>"
    )
    judged = review.judge(submit(spark, **over), signals, planted, profile).head()
    assert judged.rejected == rejected
    if rejected is None:
        assert judged.severity == severity
        if over == {}:
            assert judged.taxonomy == "a.b" and judged.entities[0].value == "10.10.0.8" and "NATed" in judged.attribution_caveat


@pytest.mark.parametrize(("ranks", "ok", "status"), [
    ([4], True, "RED"), ([3, 3], True, "RED"), ([3], True, "AMBER"), ([2, 2, 2], True, "AMBER"), ([2, 2, -1], True, "GREEN"), ([], True, "GREEN"), ([], False, "RED"),
])
def test_status(spark, ranks, ok, status):
    findings = spark.createDataFrame([(r,) for r in ranks], "severity int")
    canaries = spark.createDataFrame([(ok,)], "detected boolean")
    assert review.rollup_status(findings, canaries).head().status == status


def test_nested_report(spark, planted, profile):
    from sentrylake.operators import reporting

    findings = spark.createDataFrame(
        [("F1", "low", 1, "a", False, None), ("F2", "high", 3, "b", False, None), ("F3", "tuned", 3, "c", True, "known")],
        "finding_id string, title string, severity int, taxonomy string, suppressed boolean, suppressed_reason string",
    ).withColumns({"confidence": F.lit("medium"), "zone": F.lit("lan"), "entities": F.array().cast("array<struct<type:string,value:string,role:string>>")})
    metrics = reporting.top_metrics_per_section(run_metrics(Context(planted, profile)), spark.createDataFrame([("fw.total", 850.0)], "key string, prior double"))
    health = quality.classify_health(quality.collection_stats(planted), manifest(spark))
    report = reporting.build_report(
        "run1", status=review.rollup_status(findings.where("not suppressed")), findings=findings, metrics=metrics, health=health,
        canaries=spark.createDataFrame([("dns_beacon", True)], "canary string, detected boolean"),
    ).head()
    assert (report.status, report.finding_count) == ("AMBER", 2)
    assert [f.finding_id for f in report.findings] == ["F2", "F1"] and [f.reason for f in report.suppressed] == ["known"]
    assert {m.key: m.delta_pct for m in report.metrics}["fw.total"] == -50.0


def test_streams_equal_batch(spark, planted):
    path = scratch_path(spark, "stream-in")
    copies = planted.select("ts", "kind", "dedup_key", "src_ip", "action").unionByName(planted.select("ts", "kind", "dedup_key", "src_ip", "action"))
    copies.repartition(3).write.parquet(path)
    source = jobs.read_files(spark, path, spark.read.parquet(path).schema)
    out = scratch_path(spark, "stream-out")
    jobs.append_to(jobs.stream_dedup(source), f"{out}/rows", f"{out}/state").awaitTermination()
    assert spark.read.parquet(f"{out}/rows").count() == 997
    # One file per micro-batch: totals arrive in several updates and the last one counts.
    small = jobs.read_files(spark, path, spark.read.parquet(path).schema, maxFilesPerTrigger=1)
    out = scratch_path(spark, "stream-totals")
    jobs.totals_to(jobs.stream_hourly_counts(small, ["kind"], "3 days"), f"{out}/rows", f"{out}/state").awaitTermination()
    got = {(r.hour, r.kind): r.n for r in jobs.read_totals(spark, f"{out}/rows", ["hour", "kind"]).collect()}
    want = {(r.hour, r.kind): 2 * r.n for r in planted.groupBy(F.date_trunc("hour", "ts").alias("hour"), "kind").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_batches_count_once_and_are_packed(spark):
    path = scratch_path(spark, "batches")
    totals, rows = BatchTable(spark, f"{path}/t", ["k"], packed=3), BatchTable(spark, f"{path}/r", packed=3)
    with pytest.raises(ValueError):
        rows.read()
    for number in range(11):
        batch = spark.createDataFrame([(number % 4, number), (None, number)], "k long, n long")
        assert totals.write(batch, number) and rows.write(batch.limit(0) if number == 5 else batch, number)
        assert len(totals.folders()) <= 6 and not totals.write(batch, number)
    assert len(rows.folders()) == 3 == len(totals.folders())  # 11 is 1 * 9 + 0 * 3 + 2: the digits in threes
    assert sorted(r.n for r in rows.read().collect()) == sorted([n for n in range(11) if n != 5] * 2)
    assert {(r.k, r.n) for r in totals.read().collect()} == {(None, 10), (0, 8), (1, 9), (2, 10), (3, 7)}
    before = totals.read().count()
    assert totals.vacuum(keep=1) > 0 and totals.read().count() == before and totals.vacuum(keep=1) == 0
    assert totals.write(batch, 11) and not totals.write(batch, 4)


def test_new_entities_once_until_they_expire(spark):
    path, out = scratch_path(spark, "entities-in"), scratch_path(spark, "entities-out")
    schema = "ts timestamp, src_ip string, dst_ip string, client_ip string, user string, domain string, device string, kind string, action string"

    def land(*rows) -> None:
        spark.createDataFrame([(datetime.fromisoformat(ts), ip, *[None] * 7) for ts, ip in rows], schema).coalesce(1).write.mode("append").parquet(path)

    def run() -> list:
        known = spark.createDataFrame([("ip", "9.9.9.9")], "etype string, value string")
        new = jobs.stream_new_entities(jobs.read_files(spark, path, schema, maxFilesPerTrigger=1), "30 days", known)
        jobs.batches_to(new, f"{out}/rows", f"{out}/state").awaitTermination()
        return sorted((r.value, str(r.first_seen.date())) for r in BatchTable(spark, f"{out}/rows").read().collect())

    land(("2026-01-01", "1.1.1.1"), ("2026-01-01", "1.1.1.1"), ("2026-01-01", "9.9.9.9"), ("2026-01-01", None))
    assert run() == [("1.1.1.1", "2026-01-01")]
    land(("2026-01-02", "1.1.1.1"), ("2026-01-02", "2.2.2.2"))
    assert run() == [("1.1.1.1", "2026-01-01"), ("2.2.2.2", "2026-01-02")]  # known across the restart
    land(("2026-04-01", "3.3.3.3"))
    run()
    land(("2026-04-02", "1.1.1.1"))
    assert run() == [("1.1.1.1", "2026-01-01"), ("1.1.1.1", "2026-04-02"), ("2.2.2.2", "2026-01-02"), ("3.3.3.3", "2026-04-01")]


def test_traffic_touching_addresses(spark, profile):
    from sentrylake.operators import query as q

    row = {"ts": START, "source": "syslog", "kind": "firewall", "action": "drop"}
    pairs = [("a", "b"), ("a", "b"), ("b", "a"), ("a", "a"), ("c", "a"), ("c", "d"), (None, "a"), ("a", None), (None, None), (None, "d")]
    events = make_events(spark, [{**row, "src_ip": s, "dst_ip": d} for s, d in pairs], profile)
    wanted = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "value string")
    got = {(r.src_ip, r.dst_ip, r.hits) for r in q.traffic_involving(events, wanted).collect()}
    assert got == {("a", "b", 2), ("b", "a", 1), ("a", "a", 1), ("c", "a", 1), (None, "a", 1), ("a", None, 1)}


SUPPRESSION = "id long, taxonomy string, entity string, title_contains string, max_severity string, reason string"
FINDING = "finding_id string, taxonomy string, title string, severity int, entities array<struct<value: string>>"


def test_suppressions_agree_with_a_loop(spark):
    rng = random.Random(5)
    some = lambda *values: rng.choice([None, "", *values])
    rules = [(i if i % 9 else None, some("a", "b"), some("e1", "e2", "e3"), some("Up", "down"), some("LOW", "HIGH"), some("why")) for i in range(60, 0, -1)]
    facts = [
        (f"F{i}" if i % 20 else None, rng.choice(["a", "b", "c", None]), rng.choice(["Going up", "DOWN and up", "still", None]), rng.choice([0, 1, 2, 4]),
         rng.choice([None, [], [("e1",)], [("e3",), (None,), ("e2",), ("e3",)]]))
        for i in range(80)
    ]
    ceilings = {"LOW": 1, "HIGH": 3}

    def fits(rule, fact):
        _, tax, ent, part, most, _ = rule
        _, f_tax, title, rank, ents = fact
        return bool(
            (tax or ent or part) and (not tax or tax == f_tax) and (not ent or ent in [e[0] for e in ents or []])
            and (not part or (title is not None and part.lower() in title.lower())) and (not most or rank <= ceilings[most])
        )

    want = []
    for fact in facts:
        hit = min((r for r in rules if r[0] is not None and fact[0] is not None and fits(r, fact)), key=lambda r: r[0], default=None)
        want.append((fact[0], hit is not None, hit and hit[0], hit and (hit[5] or "suppressed")))
    done = review.apply_suppressions(spark.createDataFrame(facts, FINDING), spark.createDataFrame(rules, SUPPRESSION))
    got = [tuple(r) for r in done.select("finding_id", "suppressed", "suppression_id", "suppressed_reason").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len({w[2] for w in want}) > 5


def test_rules_of_one_taxonomy_dont_multiply_findings(spark):
    rules = spark.range(500).selectExpr("id", "'a' taxonomy", "cast(null as string) entity", "'' title_contains", "if(id % 2 = 0, 'LOW', null) max_severity", "'why' reason")
    apart = spark.range(500).selectExpr("id + 500", "'a' taxonomy", "concat('e', id) entity", "'' title_contains", "'' max_severity", "'why' reason")
    facts = spark.range(300).selectExpr("concat('F', id) finding_id", "'a' taxonomy", "'t' title", "1 severity", "array(named_struct('value', concat('e', id))) entities")
    assert review.suppression_hits(facts, rules.union(apart)).count() == 300 * 3
