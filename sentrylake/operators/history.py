"""What earlier runs know: entities, metrics, findings, retained slices, watchlist, suppressions.

History tables are append-only Parquet. An upsert becomes an append plus a grouping view, so a run
can be taken back and a lost executor never leaves a half-updated row. Every function takes the
reference time as an argument; none reads the clock.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrylake.operators import match
from sentrylake.operators import query as q
from sentrylake.profile import Profile
from sentrylake.session import materialize

NOVELTY_GRACE = timedelta(hours=1)

# Logon actions whose ``user`` is an account name rather than a hardware address.
ACCOUNT_ACTIONS = (
    "logon_success", "logon_failed", "privileged", "explicit_creds", "lockout",
    "ssh_accepted", "ssh_failed", "ssh_invalid",
)

ENTITY_COLUMNS = ("etype", "value", "first_seen", "last_seen", "occurrences")


def instant(value: datetime | str) -> Column:
    """A UTC point in time as a literal."""
    text = value if isinstance(value, str) else value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.to_timestamp(F.lit(text))


def before(as_of: datetime | str, **ago) -> Column:
    """``as_of`` minus some days or hours."""
    return instant(as_of) - F.lit(timedelta(**ago))


# ----- runs and metrics


def last_finished_run(runs: DataFrame, other_than: str | None = None) -> DataFrame:
    """The newest run with a finish time, other than the given one (one row or none)."""
    done = runs.where(F.col("finished_at").isNotNull())
    if other_than is not None:
        done = done.where(F.col("run_id") != other_than)
    return done.orderBy(F.desc("started_at"), F.desc("run_id")).limit(1)


def recent_runs(runs: DataFrame, n: int = 30) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(n)


def next_run_number(runs: DataFrame) -> DataFrame:
    return runs.agg((F.count("*") + 1).alias("run_number"))


def prior_metrics(runs: DataFrame, metrics: DataFrame, run_id: str | None = None) -> DataFrame:
    """Numeric metrics (``key, prior``) of the latest finished other run."""
    latest = last_finished_run(runs, run_id).select("run_id").scalar()
    return metrics.where((F.col("run_id") == latest) & F.col("value_num").isNotNull()).select(
        "key", F.col("value_num").alias("prior")
    )


def with_prior(metrics: DataFrame, prior: DataFrame) -> DataFrame:
    """Attach the prior value and the percentage change to current metrics."""
    from sentrylake.functions.scalars import delta_pct

    joined = metrics.join(prior, "key", "left")
    return joined.withColumn("delta_pct", delta_pct("value_num", "prior"))


def metric_history(
    metrics: DataFrame, key: str, as_of: datetime | str, days: int = 30
) -> DataFrame:
    """One metric over time, oldest first: ``ts, value_num, value_text``."""
    return (
        metrics.where((F.col("key") == key) & (F.col("ts") >= before(as_of, days=days)))
        .select("ts", "value_num", "value_text")
        .orderBy("ts")
    )


# ----- entities


def entity_structs() -> Column:
    """The entities one event names, as an array of (etype, value); values may be null.

    DNS events name their domain and client, all others their source; ``user`` is an account on
    logon events and a device address elsewhere.
    """
    dns = F.col("kind") == "dns"
    account = (F.col("kind") == "auth") & F.coalesce(
        F.col("action").isin(*ACCOUNT_ACTIONS), F.lit(False)
    )
    pair = lambda etype, value: F.struct(etype.alias("etype"), value.alias("value"))
    return F.array(
        pair(F.lit("domain"), F.when(dns, F.lower("domain"))),
        pair(F.lit("ip"), F.when(dns, F.col("client_ip")).otherwise(F.col("src_ip"))),
        pair(F.when(account, "user").otherwise("device"), F.col("user")),
    )


def entity_pairs(events: DataFrame) -> DataFrame:
    """Entity occurrences (``etype, value, n``) of a set of events."""
    return (
        events.select(F.explode(entity_structs()).alias("e"))
        .where(F.coalesce(F.col("e.value"), F.lit("")) != "")
        .groupBy("e.etype", "e.value")
        .agg(F.count("*").alias("n"))
    )


def destination_pairs(events: DataFrame) -> DataFrame:
    """Destinations of traffic as entities of their own type, for sites that want them tracked."""
    return (
        q.distinct_values(events, "dst_ip", kind=list(q.TRAFFIC_KINDS))
        .groupBy(F.lit("dst_ip").alias("etype"), "value")
        .agg(F.count("*").alias("n"))
    )


def observations(
    events: DataFrame, run_id: str, seen_at: datetime | str, *, observe_dst: bool = False
) -> DataFrame:
    """Rows to append to the observation table for one run."""
    pairs = entity_pairs(events)
    if observe_dst:
        pairs = pairs.unionByName(destination_pairs(events))
    return pairs.select(
        F.lit(run_id).alias("run_id"), "etype", "value", instant(seen_at).alias("seen_at"), "n"
    )


def entities(observed: DataFrame) -> DataFrame:
    """First and last sighting and total occurrences per entity."""
    return observed.groupBy("etype", "value").agg(
        F.min("seen_at").alias("first_seen"),
        F.max("seen_at").alias("last_seen"),
        F.sum("n").alias("occurrences"),
    )


def entity_first_seen(known: DataFrame, etype: str, values: DataFrame) -> DataFrame:
    """First sighting of the given values that are known."""
    mine = known.where(F.col("etype") == etype).select("value", "first_seen")
    return values.select("value").distinct().join(mine, "value")


def entity_info(known: DataFrame, value: str) -> DataFrame:
    return known.where(F.col("value") == value).orderBy("etype").limit(1)


def novel(
    values: DataFrame,
    known: DataFrame,
    etype: str,
    as_of: datetime | str,
    grace: timedelta = NOVELTY_GRACE,
) -> DataFrame:
    """Values (column ``value``) unknown before this run: no sighting, or first seen within grace."""
    mine = known.where(F.col("etype") == etype).select("value", "first_seen")
    cutoff = instant(as_of) - F.lit(grace)
    return (
        values.join(mine, "value", "left")
        .where(F.col("first_seen").isNull() | (F.col("first_seen") >= cutoff))
        .drop("first_seen")
    )


# ----- findings


def finding_recurrence(
    findings: DataFrame, taxonomy: str, as_of: datetime | str, days: int = 30
) -> DataFrame:
    """Distinct runs with this taxonomy per named entity (``value, prior_runs``), for all at once."""
    return (
        findings.where((F.col("taxonomy") == taxonomy) & (F.col("ts") >= before(as_of, days=days)))
        .select("run_id", F.explode("entities.value").alias("value"))
        .groupBy("value")
        .agg(F.count_distinct("run_id").alias("prior_runs"))
    )


def taxonomy_recurrence(
    findings: DataFrame, as_of: datetime | str, days: int = 30
) -> DataFrame:
    """Distinct runs per taxonomy."""
    return (
        findings.where(F.col("ts") >= before(as_of, days=days))
        .groupBy("taxonomy")
        .agg(F.count_distinct("run_id").alias("prior_runs"))
    )


def latest(rows: DataFrame, limit: int | None, *order) -> DataFrame:
    """All rows, or the first ``limit`` in this order."""
    return rows if limit is None else rows.orderBy(*order).limit(limit)


def prior_findings_for(
    findings: DataFrame, value: str, as_of: datetime | str, days: int = 90, limit: int | None = None
) -> DataFrame:
    """The latest findings that name an entity."""
    named = F.exists("entities", lambda e: e["value"] == value)
    return (
        latest(findings.where((F.col("ts") >= before(as_of, days=days)) & named), limit, F.desc("ts"), "run_id", "finding_id")
        .select("ts", "title", "severity", "taxonomy", "run_id")
    )


def entity_history(
    known: DataFrame, findings: DataFrame, value: str, as_of: datetime | str, days: int = 90
) -> DataFrame:
    """Baseline row of an entity beside its earlier findings; one row with nulls when unknown."""
    info = entity_info(known, value).select(
        F.struct("etype", "first_seen", "last_seen", "occurrences").alias("b")
    )
    past = prior_findings_for(findings, value, as_of, days).agg(
        F.sort_array(
            F.collect_list(F.struct("ts", "title", "severity", "taxonomy")), asc=False
        ).alias("f")
    )
    spark = known.sparkSession
    return spark.range(1).select(
        F.lit(value).alias("entity"),
        info.scalar().alias("baseline"),
        past.scalar().alias("prior_findings"),
    )


# ----- retained slices


def build_ioc_dns(events: DataFrame, run_id: str, day: str) -> DataFrame:
    """Narrow DNS slice kept for months: (client, domain) with lookups and blocked lookups."""
    return (
        q.where(events, kind="dns")
        .where(F.coalesce(F.col("domain"), F.lit("")) != "")
        .groupBy("client_ip", "domain")
        .agg(
            F.count("*").alias("queries"),
            F.count_if(F.col("blocked") == F.lit(True)).alias("blocked"),
        )
        .select(
            F.lit(run_id).alias("run_id"), F.to_date(F.lit(day)).alias("day"),
            "client_ip", "domain", "queries", "blocked",
        )
    )


def build_ioc_flow(events: DataFrame, profile: Profile, run_id: str, day: str) -> DataFrame:
    """Narrow traffic slice kept for months: pairs, port and protocol towards the outside."""
    return (
        q.where(events, kind=list(q.TRAFFIC_KINDS))
        .where(F.col("dst_ip").isNotNull())
        .groupBy("src_ip", "dst_ip", "dst_port", "proto")
        .agg(F.count("*").alias("hits"))
        .where(profile.is_external("dst_ip"))
        .select(
            F.lit(run_id).alias("run_id"), F.to_date(F.lit(day)).alias("day"),
            "src_ip", "dst_ip", "dst_port", "proto", "hits",
        )
    )


def _since(as_of: datetime | str, days: int) -> Column:
    return F.to_date(before(as_of, days=days))


def hunt_domain(
    ioc_dns: DataFrame, pattern: str, as_of: datetime | str, days: int = 180, limit: int | None = None
) -> DataFrame:
    """Retained lookups of names like ``pattern`` (a substring unless it has wildcards)."""
    like = pattern if "%" in pattern else f"%{pattern}%"
    return (
        latest(ioc_dns.where((F.col("day") >= _since(as_of, days)) & F.col("domain").ilike(like)), limit, F.desc("day"), "client_ip", "domain", "run_id")
        .select("day", "client_ip", "domain", "queries", "blocked")
    )


def hunt_ip(
    ioc_flow: DataFrame, ip: str, as_of: datetime | str, days: int = 180, limit: int | None = None
) -> DataFrame:
    """Retained traffic from or to an address."""
    touches = (F.col("src_ip") == ip) | (F.col("dst_ip") == ip)
    return (
        latest(ioc_flow.where((F.col("day") >= _since(as_of, days)) & touches), limit, F.desc("day"), "src_ip", "dst_ip", "dst_port", "proto", "run_id")
        .select("day", "src_ip", "dst_ip", "dst_port", "proto", "hits")
    )


def history_ips(ioc_flow: DataFrame, as_of: datetime | str, days: int = 180) -> DataFrame:
    """Distinct retained addresses."""
    return (
        ioc_flow.where(F.col("day") >= _since(as_of, days))
        .select(F.explode(F.array("src_ip", "dst_ip")).alias("value"))
        .where(F.col("value") != "")
        .distinct()
    )


def history_domains(ioc_dns: DataFrame, as_of: datetime | str, days: int = 180) -> DataFrame:
    """Distinct retained domains."""
    return (
        ioc_dns.where((F.col("day") >= _since(as_of, days)) & (F.col("domain") != ""))
        .select(F.col("domain").alias("value"))
        .distinct()
    )


def flow_history_for(
    ioc_flow: DataFrame, ips: DataFrame, as_of: datetime | str, days: int = 180
) -> DataFrame:
    """Retained traffic touching ``ips``, summed per calendar day."""
    keys = ["day", "src_ip", "dst_ip", "dst_port", "proto"]
    rows = ioc_flow.where(F.col("day") >= _since(as_of, days)).select(*keys, "hits")
    summed = q.touching(rows, ips).groupBy(*keys, "value").agg(F.sum("hits").alias("hits"))
    return summed.groupBy(*keys).agg(F.max("hits").alias("hits"))


def dns_history_for(
    ioc_dns: DataFrame, domains: DataFrame, as_of: datetime | str, days: int = 180
) -> DataFrame:
    """Retained lookups of ``domains``, summed per calendar day."""
    wanted = domains.select(F.col("value").alias("domain")).distinct()
    return (
        ioc_dns.where(F.col("day") >= _since(as_of, days))
        .join(wanted, "domain", "left_semi")
        .groupBy("day", "client_ip", "domain")
        .agg(F.sum("queries").alias("queries"), F.sum("blocked").alias("blocked"))
    )


def _worst(matches: DataFrame) -> DataFrame:
    """Per matched value, the indicator with the highest severity (its text decides ties)."""
    rank = F.struct("severity", "indicator")
    return matches.groupBy("value").agg(
        F.max_by("indicator", rank).alias("indicator"),
        F.max_by("tier", rank).alias("tier"),
        F.max("severity").alias("severity"),
    )


def retro_hunt(
    ioc_flow: DataFrame,
    ioc_dns: DataFrame,
    indicators: DataFrame,
    as_of: datetime | str,
    days: int = 180,
) -> DataFrame:
    """Indicator lists against months of retained history: one row per matched value and day."""
    ips = _worst(match.match_ips(history_ips(ioc_flow, as_of, days), indicators))
    names = _worst(match.match_domains(history_domains(ioc_dns, as_of, days), indicators))
    # Each filters the history and labels the result: written once, with a size the planner knows.
    ips, names = materialize(ips, "hunt-addresses"), materialize(names, "hunt-domains")
    flow = flow_history_for(ioc_flow, ips, as_of, days)
    by_ip = (
        flow.withColumn("value", F.explode(F.array_distinct(F.array("src_ip", "dst_ip"))))
        .groupBy("value", "day")
        .agg(F.sum("hits").alias("hits"))
        .join(ips, "value")
        .withColumn("blocked", F.lit(None).cast("bigint"))
    )
    by_name = (
        dns_history_for(ioc_dns, names, as_of, days)
        .groupBy(F.col("domain").alias("value"), "day")
        .agg(F.sum("queries").alias("hits"), F.sum("blocked").alias("blocked"))
        .join(names, "value")
    )
    columns = ["value", "indicator", "tier", "severity", "day", "hits", "blocked"]
    return by_ip.select(*columns).unionByName(by_name.select(*columns))


# ----- small keyed tables

WATCH_SCHEMA = T.StructType(
    [
        T.StructField("entity_type", T.StringType()),
        T.StructField("entity_value", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("expires_at", T.TimestampType()),
    ]
)


def _not_expired(as_of: datetime | str) -> Column:
    return F.col("expires_at").isNull() | (F.col("expires_at") >= instant(as_of))


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest row per key, by partial aggregation, so that a hot key is combined map-side."""
    rest = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, "_row.*")
        .select(*rows.columns)
    )


def active_watchlist(watchlist: DataFrame, as_of: datetime | str) -> DataFrame:
    return watchlist.where(_not_expired(as_of))


def add_watch(watchlist: DataFrame, updates: DataFrame, as_of: datetime | str) -> DataFrame:
    """Watchlist after updates (``entity_type, entity_value, reason, expires_days``): a new entry
    replaces the old one of its key and lasts at least a day."""
    fresh = updates.select(
        "entity_type",
        "entity_value",
        "reason",
        instant(as_of).alias("created_at"),
        F.timestamp_add("DAY", F.greatest(F.lit(1), F.col("expires_days")), instant(as_of)).alias(
            "expires_at"
        ),
    )
    keys = ["entity_type", "entity_value"]
    fresh = latest_per_key(fresh, keys, ["expires_at", "reason"])
    return watchlist.join(fresh, keys, "left_anti").unionByName(fresh)


def remove_watch(watchlist: DataFrame, removals: DataFrame) -> DataFrame:
    return watchlist.join(removals, ["entity_type", "entity_value"], "left_anti")


def active_suppressions(suppressions: DataFrame, as_of: datetime | str) -> DataFrame:
    return suppressions.where(_not_expired(as_of))


def add_suppressions(suppressions: DataFrame, rules: DataFrame, as_of: datetime | str) -> DataFrame:
    """Suppressions with new rules (``taxonomy, entity, title_contains, max_severity, reason, expires_days``).

    Rules get the next numbers in the order of their texts; one that names nothing to suppress is left out,
    one without days never ends.
    """
    last = suppressions.agg(F.coalesce(F.max("id"), F.lit(0)))
    texts = ["taxonomy", "entity", "title_contains"]
    given = rules.where(F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in texts]).isNotNull())
    number = F.row_number().over(Window.orderBy(*texts, "max_severity", "reason", "expires_days"))
    fresh = given.select(
        (last.scalar() + number).alias("id"), *texts, "max_severity", "reason", instant(as_of).alias("created_at"),
        F.when(F.col("expires_days").isNotNull(), F.timestamp_add("DAY", F.greatest(F.lit(1), F.col("expires_days").cast("int")), instant(as_of))).alias("expires_at"),
        F.lit(0).cast("bigint").alias("hits"),
    )
    return suppressions.unionByName(fresh, allowMissingColumns=True)


def bump_suppressions(suppressions: DataFrame, matched: DataFrame) -> DataFrame:
    """Suppressions with their hit counters raised by the matches of a run (column ``id``)."""
    more = matched.groupBy("id").agg(F.count("*").alias("_more"))
    return (
        suppressions.join(more, "id", "left")
        .withColumn("hits", F.coalesce(F.col("hits"), F.lit(0)) + F.coalesce(F.col("_more"), F.lit(0)))
        .drop("_more")
    )


def cache_latest(cache: DataFrame, as_of: datetime | str | None = None) -> DataFrame:
    """Latest answer per (enricher, subject); expired answers are left out when ``as_of`` is given."""
    newest = latest_per_key(cache, ["enricher", "subject"], ["fetched_at"])
    return newest if as_of is None else newest.where(F.col("expires_at") >= instant(as_of))


# ----- the bundle handed to detectors


@dataclass(frozen=True)
class Baseline:
    """Earlier knowledge for one run. Every frame may be empty."""

    as_of: str
    known: DataFrame
    prior: DataFrame
    findings: DataFrame
    metrics: DataFrame
    watchlist: DataFrame

    def novel(self, values: DataFrame, etype: str) -> DataFrame:
        return novel(values, self.known, etype, self.as_of)

    def when_present(self, rows: DataFrame) -> DataFrame:
        """``rows`` when an earlier run left numeric metrics, else none: on a first run everything
        would be new."""
        return rows.where(self.prior.select("key").exists())

    def prior_value(self, key: str) -> Column:
        return self.prior.where(F.col("key") == key).select("prior").limit(1).scalar()

    def recurrence(self, taxonomy: str, days: int = 30) -> DataFrame:
        return finding_recurrence(self.findings, taxonomy, self.as_of, days)


def with_recurrence(
    rows: DataFrame, baseline: Baseline | None, taxonomy: str, column: str
) -> DataFrame:
    """Attach how many earlier runs reported ``taxonomy`` for the entity in ``column``."""
    if baseline is None:
        return rows.withColumn("prior_runs", F.lit(0).cast("bigint"))
    past = baseline.recurrence(taxonomy).select(F.col("value").alias("_entity"), "prior_runs")
    joined = rows.join(past, rows[column] == past["_entity"], "left").drop("_entity")
    return joined.withColumn("prior_runs", F.coalesce(F.col("prior_runs"), F.lit(0)))
