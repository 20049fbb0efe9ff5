"""Activity that involves listed indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.functions.scalars import TIER_CONFIDENCE, entity_list, is_allowed_action, lookup
from sentrylake.operators import match
from sentrylake.operators import metrics as M
from sentrylake.operators import query as q
from sentrylake.operators.signals import as_signals, distinct_lists, entities_of, join_lists, text
from sentrylake.profile import Profile
from sentrylake.schema import LOW
from sentrylake.session import materialize

ANALYZER = "ioc_match"
LISTED = 10
_KEY = ["kind", "indicator"]


def _confidence() -> Column:
    return F.coalesce(lookup(F.col("tier"), TIER_CONFIDENCE), F.lit(0.5))


def ip_activity(events: DataFrame, indicators: DataFrame) -> DataFrame:
    """Traffic grouped by (indicator, pair, port, protocol, action) with its direction.

    Matching runs on distinct addresses. The matched addresses then filter the events by either end
    before anything is grouped, so only traffic with a listed address is shuffled. A pair whose
    ends both match the same indicator (``ends`` is 2) counts once, as inbound.
    """
    found = match.match_ips(q.all_traffic_ips(events), indicators).select("value", *_KEY)
    matches = materialize(found, "ioc-addresses")
    columns = ["src_ip", "dst_ip", "dst_port", "proto", "action"]
    end = lambda value, inbound: F.struct(
        F.col(value).alias("value"), F.lit(inbound).alias("inbound")
    )
    ends = (
        q.where(events, kind=list(q.TRAFFIC_KINDS))
        .select("ts", *columns, F.explode(F.array(end("src_ip", True), end("dst_ip", False))).alias("e"))
        .select("ts", *columns, "e.*")
        .where(F.col("value").isNotNull())
    )
    per_end = (
        ends.join(matches, "value")
        .groupBy(*_KEY, *columns, "inbound")
        .agg(F.count("*").alias("hits"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    )
    return per_end.groupBy(*_KEY, *columns).agg(
        F.max("hits").alias("hits"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.bool_or("inbound").alias("inbound"),
        F.count("*").alias("ends"),
    )


def ip_match(events: DataFrame, indicators: DataFrame, profile: Profile) -> DataFrame:
    """One signal per listed address or network that appears in traffic.

    Totals, ports and address lists all come from the matched activity. That is a small part of the
    traffic, so it is written once and read three times rather than scanning the events again.
    """
    activity = materialize(ip_activity(events, indicators), "ioc-activity")
    hits, inbound = F.col("hits"), F.col("inbound")
    allowed = is_allowed_action("action")
    total = lambda test: F.coalesce(F.sum(F.when(test, hits)), F.lit(0))
    groups = activity.groupBy(*_KEY).agg(
        total(inbound & allowed).alias("inbound_accepted"),
        total(inbound & ~allowed).alias("inbound_blocked"),
        total(~inbound & allowed).alias("outbound_allowed"),
        total(~inbound & ~allowed).alias("outbound_blocked"),
        F.bool_or(~inbound).alias("any_outbound"),
        F.min("first_ts").alias("first_seen"),
        F.max("last_ts").alias("last_seen"),
    )
    # Ports by hits, at most ten per indicator.
    by_port = (
        activity.where(F.col("dst_port").isNotNull())
        .groupBy(*_KEY, "dst_port")
        .agg(F.sum("hits").alias("n"))
    )
    order = Window.partitionBy(*_KEY).orderBy(F.desc("n"), "dst_port")
    ports = (
        by_port.withColumn("_r", F.row_number().over(order))
        .where(F.col("_r") <= LISTED)
        .groupBy(*_KEY)
        .agg(F.sort_array(F.collect_list(F.struct("_r", "dst_port"))).alias("_ports"))
    )
    # A pair with one matched end names a listed and a local address; with two, only listed ones.
    both = F.col("ends") == 2
    seen = (
        F.when(both, F.array("src_ip", "dst_ip"))
        .when(inbound, F.array("src_ip"))
        .otherwise(F.array("dst_ip"))
    )
    other = F.when(~both, F.when(inbound, F.col("dst_ip")).otherwise(F.col("src_ip")))
    lists = distinct_lists(
        activity, _KEY, {"matched": (seen, LISTED), "local_addresses": (other, LISTED)}
    )
    listed = indicators.where(F.col("kind").isin("ip", "cidr")).withColumnRenamed("value", "indicator")
    rows = groups.join(ports, _KEY, "left").withColumn(
        "dst_ports",
        F.coalesce(F.transform("_ports", lambda s: s["dst_port"]), F.array().cast("array<int>")),
    )
    rows = join_lists(rows, lists, _KEY).join(listed, _KEY)
    closed = ~F.col("any_outbound") & (F.col("inbound_accepted") == 0)
    rows = rows.withColumn("severity_capped", closed & (F.col("severity") > LOW))
    what = (
        F.when(F.col("any_outbound"), "contacted by an internal host")
        .when(F.col("inbound_accepted") > 0, "connected in and was accepted")
        .otherwise("probed the network, all blocked")
    )
    return as_signals(
        rows,
        signal_id=text("ioc.", F.col("kind"), ".", F.col("indicator")),
        analyzer=ANALYZER,
        title=text("IoC-listed address ", F.col("indicator"), " ", what),
        taxonomy="ioc.ip_match",
        severity=F.when(F.col("severity_capped"), LOW).otherwise(F.col("severity")),
        confidence=_confidence(),
        entities=entities_of(
            entity_list("ip", "matched", "indicator"), entity_list("ip", "local_addresses", "local")
        ),
        evidence=[
            "indicator", F.col("kind").alias("indicator_type"), F.col("origin").alias("list"),
            "tier", F.col("source").alias("list_source"), "campaign", "warning",
            F.col("expires").alias("alert_until"), "matched", "inbound_accepted",
            "inbound_blocked", "outbound_allowed", "outbound_blocked", "dst_ports",
            F.transform(
                "local_addresses",
                lambda ip: F.struct(ip.alias("ip"), profile.zone_of(ip).alias("zone")),
            ).alias("local_addresses"),
            "first_seen", "last_seen", "severity_capped",
        ],
    )


def domain_match(events: DataFrame, indicators: DataFrame) -> DataFrame:
    """One signal per listed domain that was looked up."""
    found = match.match_domains(q.all_dns_domains(events), indicators).select("value", *_KEY)
    matches = materialize(found, "ioc-domains")
    pairs = matches.select(F.col("value").alias("domain"), *_KEY)
    activity = materialize(q.lookups_of(events, matches).join(pairs, "domain"), "ioc-lookups")
    groups = activity.groupBy(*_KEY).agg(
        F.sum("queries").alias("queries"),
        F.sum("blocked").alias("blocked_by_resolver"),
        F.count_distinct("client_ip").alias("client_count"),
        F.min("first_ts").alias("first_seen"),
        F.max("last_ts").alias("last_seen"),
    )
    lists = distinct_lists(
        activity, _KEY,
        {"matched": (F.col("domain"), LISTED), "clients": (F.col("client_ip"), LISTED)},
    )
    listed = indicators.where(F.col("kind").isin("domain", "domain_suffix")).withColumnRenamed(
        "value", "indicator"
    )
    rows = join_lists(groups, lists, _KEY).join(listed, _KEY)
    return as_signals(
        rows,
        signal_id=text("ioc.", F.col("kind"), ".", F.col("indicator")),
        analyzer=ANALYZER,
        title=text(
            "IoC-listed domain ", F.col("indicator"), " looked up by ", F.col("client_count"),
            " client(s)",
        ),
        taxonomy="ioc.domain_match",
        severity=F.col("severity"),
        confidence=_confidence(),
        entities=entities_of(
            entity_list("domain", "matched", "indicator"), entity_list("ip", "clients", "client")
        ),
        evidence=[
            "indicator", F.col("kind").alias("indicator_type"), F.col("origin").alias("list"),
            "tier", F.col("source").alias("list_source"), "campaign", "warning",
            F.col("expires").alias("alert_until"), "matched", "queries", "blocked_by_resolver",
            "clients", "first_seen", "last_seen",
        ],
    )


def indicator_metrics(events: DataFrame, indicators: DataFrame) -> DataFrame:
    """How many indicators were checked and how many were seen."""
    ips = match.match_ips(q.all_traffic_ips(events), indicators).select(*_KEY)
    names = match.match_domains(q.all_dns_domains(events), indicators).select(*_KEY)
    seen = ips.unionByName(names).distinct().agg(F.count("*")).scalar()
    row = indicators.agg(F.count("*").alias("checked")).where(F.col("checked") > 0)
    return M.stats(
        row.withColumn("seen", seen),
        [
            M.Stat("ioc.indicators", "checked", "general", "IoC list indicators checked"),
            M.Stat("ioc.matched", "seen", "general", "IoC list indicators seen"),
        ],
        7100,
    )
