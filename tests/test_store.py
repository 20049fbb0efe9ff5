"""Published runs, entity sightings and versioned small tables."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import END, START
from sentrylake.operators import history as H
from sentrylake.operators.perimeter import persistent_prober, volume_metrics
from sentrylake.schema import SIGNAL_SCHEMA
from sentrylake.session import scratch_path
from sentrylake.sources import published
from sentrylake.sources.entities import AlreadyMerged, EntityStore
from sentrylake.sources.runstore import TABLES, RunStore
from sentrylake.sources.sinks import RunDeletionError
from sentrylake.sources.snapshots import AnswerCache, Suppressions, VersionedTable, Watchlist

LATER = datetime.now() + timedelta(days=1)


def counts(df, column="run_id"):
    return {r[column]: r["count"] for r in df.groupBy(column).count().collect()}


@pytest.mark.parametrize("way", ["local", "renamed"])
def test_one_of_several_writers_gets_a_name(spark, way, monkeypatch):
    if way == "renamed":  # the way of file systems other than the local one
        monkeypatch.setattr(published, "_publish_local", lambda target, body, replace: published._publish_renamed(spark, *published.locate(spark, "file:" + target), body, replace))
    uri = scratch_path(spark, "names") + "/1.json"
    assert [published.publish(spark, uri, {"n": n}) for n in (1, 2)] == [True, False]
    assert published.content(spark, uri) == {"n": 1}
    assert published.publish(spark, uri, {"n": 3}, replace=True) and published.content(spark, uri) == {"n": 3}
    assert published.names(spark, uri.rsplit("/", 1)[0]) == ["1.json"]
    assert published.names(spark, uri + "-none") == []


def test_a_run_is_seen_whole_or_not(spark, planted, profile):
    store = RunStore(spark, scratch_path(spark, "runs"))
    assert {t: (store.read(t).count(), store.read(t).schema) for t in TABLES} == {t: (0, s) for t, (s, _) in TABLES.items()}
    first = store.begin("day/1", "2026-05-31 12:00:00")
    first.events(planted)
    first.signals(persistent_prober(planted, profile))
    assert store.read("events").count() == 0 and store.runs().first().finished_at is None
    first.metrics(volume_metrics(planted), END)
    first.write("ioc_dns", H.build_ioc_dns(planted, "x", "2026-05-31"))
    first.commit(END)
    assert counts(store.read("events")) == {"day/1": 997} and store.read("signals").count() == 1
    assert store.read("events").where("kind = 'dns'").count() == 572
    assert store.read("events", ["other"]).count() == 0
    assert store.read("metrics").where("key = 'fw.total'").first().value_num == 425

    killed = store.begin("day/1", "2026-05-31 13:00:00")  # dies before its other tables
    killed.events(planted.limit(3))
    assert store.read("events").count() == 997 and store.read("signals").count() == 1
    again = store.begin("day/1", "2026-05-31 14:00:00")
    again.events(planted.where("kind = 'dns'"))
    again.signals(persistent_prober(planted.where("kind = 'dns'"), profile))
    again.commit("2026-06-01 13:00:00")
    assert store.read("events").count() == 572 and store.read("signals").count() == 0 and store.read("ioc_dns").count() == 0
    assert store.read("signals").schema.names[:-1] == SIGNAL_SCHEMA.names
    assert [(r.run_id, r.number) for r in store.runs().collect()] == [("day/1", 1)]
    assert store.vacuum(datetime(2020, 1, 1)) == 0
    assert store.vacuum(LATER) == 5 and store.read("events").count() == 572


def test_retention_and_removal_of_runs(spark, planted):
    store = RunStore(spark, scratch_path(spark, "runs"))
    for i, day in enumerate(("2024-01-01", "2026-01-01", "2026-05-30")):
        run = store.begin(f"r{i}", f"{day} 00:00:00")
        run.events(planted.limit(10))
        run.metrics(volume_metrics(planted), f"{day} 00:00:00")
        run.write("ioc_dns", H.build_ioc_dns(planted, "x", day).limit(5))
        run.commit(f"{day} 01:00:00")
    open_run = store.begin("r3", "2026-06-01 00:00:00")
    assert store.purge(datetime(2026, 6, 1)) == {"events": store_parts(2), "metrics": 1, "ioc_dns": 1}
    assert counts(store.read("events")) == {"r2": 10}
    assert set(counts(store.read("metrics"))) == {"r1", "r2"} and counts(store.read("ioc_dns")) == {"r1": 5, "r2": 5}
    with pytest.raises(RunDeletionError):
        store.delete_run("r9")
    with pytest.raises(RunDeletionError):
        store.delete_run("r3")
    assert store.delete_run("r3", force=True) == {} and open_run.number == 4
    assert store.delete_run("r1") == {"metrics": 1, "ioc_dns": 1}
    assert {r.run_id for r in store.runs().collect()} == {"r0", "r2"} and set(counts(store.read("metrics"))) == {"r2"}


def store_parts(runs):
    """Ten planted events are of one kind."""
    return runs


def observed(spark, rows, at):
    return spark.createDataFrame(rows, "etype string, value string, n bigint").withColumn("seen_at", F.lit(at).cast("timestamp"))


def test_entities_of_three_runs(spark):
    store = EntityStore(spark, scratch_path(spark, "baseline"), buckets=4)
    assert store.known().count() == 0
    hot = [("ip", f"10.0.0.{i}", i + 1) for i in range(50)]
    store.observe("a", observed(spark, hot, "2026-05-01 00:00:00"))
    store.observe("b", observed(spark, [("ip", "10.0.0.7", 5), ("user", "10.0.0.7", 1), ("ip", "gone", 1)], "2026-05-02 00:00:00"))
    store.observe("b", observed(spark, [("ip", "10.0.0.7", 5), ("user", "10.0.0.7", 1)], "2026-05-02 00:00:00"))
    store.observe("c", observed(spark, [("domain", "x.example", 2)], "2026-06-01 11:30:00"))
    before = {tuple(r) for r in store.known().collect()}
    assert len(before) == 52 and ("ip", "10.0.0.7", datetime(2026, 5, 1), datetime(2026, 5, 2), 13) in before
    asked = spark.createDataFrame([("10.0.0.7",), ("gone",), ("x.example",)], "value string")
    assert {r.value for r in store.novel(asked, "ip", END).collect()} == {"gone", "x.example"}
    assert {r.value for r in store.novel(asked, "domain", END).collect()} == {"10.0.0.7", "gone", "x.example"}
    store.compact()
    assert {tuple(r) for r in store.known().collect()} == before
    with pytest.raises(AlreadyMerged):
        store.observe("a", observed(spark, hot, "2026-05-01 00:00:00"))
    store.observe("d", observed(spark, [("ip", "late", 1)], "2026-06-01 11:59:00"))
    other = EntityStore(spark, store.folder.rsplit("/", 1)[0])
    assert len(other.known().collect()) == 53
    other.forget("d")
    assert {tuple(r) for r in store.known().collect()} == before
    assert store.vacuum(LATER) == 5 and {tuple(r) for r in store.known().collect()} == before


def test_novelty_does_not_shuffle_history(spark):
    store = EntityStore(spark, scratch_path(spark, "baseline"), buckets=4)
    store.observe("a", observed(spark, [("ip", f"v{i}", 1) for i in range(100)], "2026-05-01 00:00:00"))
    store.observe("b", observed(spark, [("ip", f"v{i}", 1) for i in range(50, 150)], "2026-05-02 00:00:00"))
    asked = spark.range(200).selectExpr("concat('v', id) as value")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = store.novel(asked, "ip", END)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = plan.index(store.name)
    history = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(history) == 1 and plan.index("Exchange hashpartitioning") < scan, plan
    assert not re.search(r"Exchange.*first_seen", plan)


def test_second_of_two_writers_starts_again(spark):
    root = scratch_path(spark, "small")
    one, two = (VersionedTable(spark, root, "numbers", spark.range(0).schema) for _ in range(2))
    calls = []

    def slow(rows):
        calls.append(rows.count())
        if len(calls) == 1:  # the other writer comes first
            assert two.update(lambda r: r.unionByName(spark.range(10, 12))) == 1
        return rows.unionByName(spark.range(3))

    assert one.update(slow) == 2 and calls == [0, 2]
    assert sorted(r.id for r in two.read().collect()) == [0, 1, 2, 10, 11]
    assert sorted(r.id for r in two.read(1).collect()) == [10, 11] and two.read(0).count() == 0
    assert one.vacuum(keep=1) == 1 and one.read().count() == 5


def test_watchlist_suppressions_and_cache(spark):
    root = scratch_path(spark, "small")
    watch = Watchlist(spark, root)
    new = spark.createDataFrame([("ip", "a", "r", 3), ("ip", "b", "r", 0)], "entity_type string, entity_value string, reason string, expires_days int")
    watch.add(new, START)
    watch.remove(new.where("entity_value = 'a'"))
    assert [r.entity_value for r in watch.active(START).collect()] == ["b"]
    watch.purge("2026-06-30 00:00:00")
    assert watch.read().count() == 0

    rules = Suppressions(spark, root)
    schema = "taxonomy string, entity string, title_contains string, max_severity string, reason string, expires_days int"
    rules.add(spark.createDataFrame([("t", None, None, "LOW", "noise", None), (None, " ", None, None, "names nothing", 3)], schema), START)
    rules.add(spark.createDataFrame([(None, "10.0.0.1", None, None, "known", 1), (None, None, "scan", None, "known", 30)], schema), START)
    assert {(r.id, r.reason, r.hits) for r in rules.read().collect()} == {(1, "noise", 0), (2, "known", 0), (3, "known", 0)}
    rules.bump(spark.createDataFrame([(1,), (1,), (9,)], "id bigint"))
    rules.delete(spark.createDataFrame([(3,), (3,)], "id bigint"))
    assert {(r.id, r.hits) for r in rules.read().collect()} == {(1, 2), (2, 0)}
    assert [r.id for r in rules.active("2026-07-30 00:00:00").collect()] == [1]

    cache = AnswerCache(spark, root)
    day = lambda d: datetime(2026, 6, d)
    answer = lambda rows: spark.createDataFrame(rows, "enricher string, subject string, fetched_at timestamp, expires_at timestamp, verdict string")
    cache.put(answer([("e", "s", day(3), day(9), "new"), ("e", "t", day(1), day(2), "old")]))
    cache.put(answer([("e", "s", day(2), day(30), "late"), ("e", "t", day(1), day(2), "old")]))
    assert {(r.subject, r.verdict) for r in cache.read().collect()} == {("s", "new"), ("t", "old")}
    assert [r.verdict for r in cache.get("2026-06-05 00:00:00").collect()] == ["new"]
    cache.purge("2026-06-05 00:00:00")
    assert cache.read().count() == 1
