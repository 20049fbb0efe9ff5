"""Read-side operators over the event table: filters, counts, rankings, samples.

Every function takes a DataFrame of events and returns a DataFrame; keyword filters are equality,
membership for a list, and no filter for ``None``. Rankings order by measure and then by key, so a
tie has one answer, and end in ``ORDER BY .. LIMIT``, which Spark runs as a top-k per task.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.functions import net
from sentrylake.schema import CANARY_SOURCE

TRAFFIC_KINDS = ("firewall", "flow")


# ----- predicates


def scope(
    events: DataFrame,
    run_id: str | None = None,
    *,
    only_sources: Iterable[str] = (),
    exclude_sources: Iterable[str] = (),
) -> DataFrame:
    """Events of one run, restricted to or away from some sources."""
    if run_id is not None:
        events = events.where(F.col("run_id") == run_id)
    if only := sorted(only_sources):
        events = events.where(F.col("source").isin(only))
    if excluded := sorted(exclude_sources):
        events = events.where(~F.col("source").isin(excluded))
    return events


def condition(events: DataFrame, filters: dict[str, Any]) -> Column:
    """The keyword filters as one predicate."""
    parts = [F.lit(True)]
    for name, value in filters.items():
        if name not in events.columns:
            raise KeyError(f"no event column {name!r}")
        if value is None:
            continue
        if isinstance(value, (list, tuple, set, frozenset)):
            parts.append(F.col(f"`{name}`").isin(list(value)))
        else:
            parts.append(F.col(f"`{name}`") == value)
    return reduce(lambda a, b: a & b, parts)


def where(events: DataFrame, **filters: Any) -> DataFrame:
    """Events that satisfy every keyword filter."""
    return events.where(condition(events, filters))


def in_zone(zone: str) -> Column:
    """Either end of the event lies in ``zone``."""
    return (F.col("src_zone") == zone) | (F.col("dst_zone") == zone)


def touching_zone(events: DataFrame, zone: str, **filters: Any) -> DataFrame:
    """Events with either end in ``zone``."""
    return where(events, **filters).where(in_zone(zone))


def is_return_traffic() -> Column:
    """TCP from a web port: late answers to sessions opened from inside."""
    return (F.col("proto") == "tcp") & F.col("src_port").isin(80, 443)


def detail_rows(
    events: DataFrame,
    *,
    programs: Sequence[str] = (),
    program_prefixes: Sequence[str] = (),
    user_suffix: str | None = None,
    raw_contains: str | None = None,
    limit: int | None = None,
    **filters: Any,
) -> DataFrame:
    """Events by program name or prefix, account suffix, or text anywhere in the raw record.

    Text tests ignore ASCII case, as the store's pattern match does.
    """
    rows = where(events, **filters)
    names = [F.col("program").isin(list(programs))] if programs else []
    names += [F.lower("program").startswith(p.lower()) for p in program_prefixes]
    if names:
        rows = rows.where(reduce(lambda a, b: a | b, names))
    if user_suffix:
        rows = rows.where(F.lower("user").endswith(user_suffix.lower()))
    if raw_contains:
        needle = raw_contains.lower()
        rows = rows.where(
            F.lower("raw_json").contains(needle) | F.lower("user").contains(needle)
        )
    if limit is not None:
        rows = rows.orderBy("ts", "id").limit(limit)
    return rows


def existing_event_ids(events: DataFrame, ids: DataFrame) -> DataFrame:
    """The subset of ``ids`` (column ``id``) that are events here.

    The events are filtered by the ids, not the ids by the events, so that the short side is the
    one that is shipped.
    """
    return events.select("id").join(ids.select("id").distinct(), "id", "left_semi").distinct()


# ----- scalars, as one-row frames


def count(events: DataFrame, **filters: Any) -> DataFrame:
    return where(events, **filters).agg(F.count("*").alias("n"))


def count_zone(events: DataFrame, zone: str, **filters: Any) -> DataFrame:
    return touching_zone(events, zone, **filters).agg(F.count("*").alias("n"))


def distinct_count(
    events: DataFrame, column: str, *, approximate: bool = False, **filters: Any
) -> DataFrame:
    """Distinct non-null values; ``approximate`` trades exactness for a single small sketch."""
    measure = F.approx_count_distinct if approximate else F.count_distinct
    return where(events, **filters).agg(measure(F.col(column)).alias("n"))


def kinds_present(events: DataFrame) -> DataFrame:
    return events.select("kind").distinct()


def sources_present(events: DataFrame) -> DataFrame:
    return events.select("source").distinct()


def time_bounds(events: DataFrame, **filters: Any) -> DataFrame:
    return where(events, **filters).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


# ----- groupings


def _ranked(df: DataFrame, measure: str, keys: Sequence[str], n: int | None) -> DataFrame:
    if n is None:
        return df
    return df.orderBy(F.desc(measure), *[F.asc_nulls_first(k) for k in keys]).limit(n)


def top(
    events: DataFrame, column: str, n: int | None = 15, *, by: str = "count", **filters: Any
) -> DataFrame:
    """Most frequent values of ``column``, or with ``by="unique:x"`` those with most distinct ``x``."""
    measure = F.count("*") if by == "count" else F.count_distinct(F.col(by.split(":", 1)[1]))
    grouped = (
        where(events, **filters)
        .where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(measure.alias("n"))
    )
    return _ranked(grouped, "n", ["value"], n)


def group_pairs(
    events: DataFrame, col_a: str, col_b: str, n: int | None = 20, **filters: Any
) -> DataFrame:
    """Counts by two columns; the first is never null, the second may be."""
    grouped = (
        where(events, **filters)
        .where(F.col(col_a).isNotNull())
        .groupBy(F.col(col_a), F.col(col_b))
        .agg(F.count("*").alias("n"))
    )
    return _ranked(grouped, "n", [col_a, col_b], n)


def hourly(events: DataFrame, **filters: Any) -> DataFrame:
    """Counts per UTC hour that has events."""
    return (
        where(events, **filters)
        .groupBy(F.date_trunc("hour", "ts").alias("hour"))
        .agg(F.count("*").alias("n"))
    )


def hourly_zone(events: DataFrame, zone: str, **filters: Any) -> DataFrame:
    return hourly(touching_zone(events, zone, **filters))


def timestamps_for(events: DataFrame, limit: int | None = None, **filters: Any) -> DataFrame:
    """Ascending timestamps."""
    stamps = where(events, **filters).select("ts").orderBy("ts")
    return stamps if limit is None else stamps.limit(limit)


def distinct_values(events: DataFrame, column: str, **filters: Any) -> DataFrame:
    return (
        where(events, **filters)
        .where(F.col(column).isNotNull())
        .select(F.col(column).alias("value"))
        .distinct()
    )


def _first(rows: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` rows, or all of them."""
    return rows if n is None else rows.limit(n)


def sample(events: DataFrame, n: int | None = 20, **filters: Any) -> DataFrame:
    """The latest ``n`` events; all of them, latest first, without a limit."""
    return _first(where(events, **filters).orderBy(F.desc("ts"), "id", "dedup_key"), n)


def sample_by_dedup(events: DataFrame, keys: DataFrame, n: int | None = 20) -> DataFrame:
    """Events carrying one of ``keys`` (column ``dedup_key``): at most ``n``, or all of them."""
    hits = events.join(keys.select("dedup_key").distinct(), "dedup_key", "left_semi")
    return _first(hits.orderBy("dedup_key", "id"), n)


# ----- DNS


def _blocked_count() -> Column:
    return F.count_if(F.col("blocked") == F.lit(True))


def dns_domain_stats(
    events: DataFrame, n: int | None = None, blocked: bool | None = None
) -> DataFrame:
    grouped = (
        where(events, kind="dns", blocked=blocked)
        .where(F.col("domain").isNotNull())
        .groupBy("domain")
        .agg(F.count("*").alias("total"), _blocked_count().alias("blocked_total"))
    )
    return _ranked(grouped, "total", ["domain"], n)


def dns_client_stats(events: DataFrame, n: int | None = None) -> DataFrame:
    grouped = (
        where(events, kind="dns")
        .where(F.col("client_ip").isNotNull())
        .groupBy("client_ip")
        .agg(F.count("*").alias("total"), _blocked_count().alias("blocked_total"))
    )
    return _ranked(grouped, "total", ["client_ip"], n)


def dns_client_domain_stats(events: DataFrame) -> DataFrame:
    """Every (client, domain) pair: a tunnel's names each occur once, so nothing is ranked away."""
    return (
        where(events, kind="dns")
        .where(F.col("client_ip").isNotNull() & F.col("domain").isNotNull())
        .groupBy("client_ip", "domain")
        .agg(F.count("*").alias("queries"))
    )


def all_dns_domains(events: DataFrame) -> DataFrame:
    return distinct_values(events, "domain", kind="dns").where(F.col("value") != "")


def lookups_of(events: DataFrame, domains: DataFrame) -> DataFrame:
    """Lookups of ``domains`` (column ``value``) by client and domain."""
    wanted = domains.select(F.col("value").alias("domain")).distinct()
    return (
        where(events, kind="dns")
        .join(wanted, "domain", "left_semi")
        .groupBy("client_ip", "domain")
        .agg(
            F.count("*").alias("queries"),
            _blocked_count().alias("blocked"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
        )
    )


# ----- traffic


def bytes_by_pair(events: DataFrame, n: int | None = None, **filters: Any) -> DataFrame:
    """Bytes and hits by (source, destination); an event without a length counts 0 bytes."""
    grouped = (
        where(events, **filters)
        .where(F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull())
        .groupBy("src_ip", "dst_ip")
        .agg(
            F.coalesce(F.sum(F.col("pkt_len").cast("bigint")), F.lit(0)).cast("bigint").alias("bytes"),
            F.count("*").alias("hits"),
        )
    )
    return _ranked(grouped, "bytes", ["src_ip", "dst_ip"], n)


def all_traffic_ips(events: DataFrame) -> DataFrame:
    """Every address on either side of firewall and flow events, in one pass."""
    return (
        where(events, kind=list(TRAFFIC_KINDS))
        .select(F.explode(F.array("src_ip", "dst_ip")).alias("value"))
        .where(F.col("value") != "")
        .distinct()
    )


def traffic_involving(events: DataFrame, ips: DataFrame) -> DataFrame:
    """Traffic from or to ``ips`` (column ``value``) by pair, port, protocol and action."""
    rows = where(events, kind=list(TRAFFIC_KINDS))
    keys = ["src_ip", "dst_ip", "dst_port", "proto", "action"]
    near = touching(rows.select(*keys, "ts"), ips).groupBy(*keys, "value")
    near = near.agg(F.count("*").alias("hits"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return near.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("hits", "first_ts", "last_ts")])


def touching(rows: DataFrame, ips: DataFrame) -> DataFrame:
    """``rows`` with a ``src_ip`` or ``dst_ip`` among ``ips`` (column ``value``), once for each such ``value``.

    A row is a row for each of its ends, so one join finds both, and ends that are null go nowhere. A row
    whose ends are both wanted is there twice: add up by value, then take either.
    """
    ends = rows.withColumn("value", F.explode(F.array_distinct(F.array_compact(F.array("src_ip", "dst_ip")))))
    return ends.join(ips.select("value").distinct(), "value", "left_semi")


def hours_between(first: Column | str, last: Column | str) -> Column:
    """Hours between two timestamps, with fractions."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (first, last))
    return (F.unix_micros(b) - F.unix_micros(a)) / 3.6e9


def source_profile(events: DataFrame, n: int | None = None, **filters: Any) -> DataFrame:
    """Shape of each source: hits, distinct ports, activity span and TTL range."""
    grouped = (
        where(events, **filters)
        .where(F.col("src_ip").isNotNull())
        .groupBy("src_ip")
        .agg(
            F.count("*").alias("hits"),
            F.count_distinct("dst_port").alias("distinct_dst_ports"),
            F.count_distinct("src_port").alias("distinct_src_ports"),
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
            F.min("ttl").alias("ttl_min"),
            F.max("ttl").alias("ttl_max"),
        )
        .withColumn("duration_hours", F.round(hours_between("first_seen", "last_seen"), 2))
    )
    return _ranked(grouped, "hits", ["src_ip"], n)


def low_ttl_pairs(events: DataFrame, max_ttl: int, **filters: Any) -> DataFrame:
    return (
        where(events, **filters)
        .where(F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull() & (F.col("ttl") <= max_ttl))
        .groupBy("src_ip", "dst_ip", "proto", "ttl")
        .agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    )


def source_ports(events: DataFrame, **filters: Any) -> DataFrame:
    """Hits by source and destination port."""
    return (
        where(events, **filters)
        .where(F.col("src_ip").isNotNull() & F.col("dst_port").isNotNull())
        .groupBy("src_ip", "dst_port")
        .agg(F.count("*").alias("n"))
    )


def ports_by_source(events: DataFrame, n: int = 10, **filters: Any) -> DataFrame:
    """The ``n`` most used destination ports of every source at once."""
    from pyspark.sql import Window

    order = Window.partitionBy("src_ip").orderBy(F.desc("n"), "dst_port")
    return (
        source_ports(events, **filters)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
    )


def subnet_spread(events: DataFrame, n: int | None = 10, **filters: Any) -> DataFrame:
    """Distinct sources and hits per IPv4 /24."""
    per_source = top(events, "src_ip", None, **filters)
    grouped = (
        per_source.select(net.subnet24("value").alias("prefix"), "n")
        .where(F.col("prefix").isNotNull())
        .groupBy("prefix")
        .agg(F.count("*").alias("sources"), F.sum("n").alias("hits"))
    )
    if n is None:
        return grouped
    return grouped.orderBy(F.desc("sources"), F.desc("hits"), "prefix").limit(n)


def return_traffic_count(events: DataFrame, **filters: Any) -> DataFrame:
    return where(events, **filters).agg(F.count_if(is_return_traffic()).alias("n"))


# ----- drill-down

DRILL_FILTERS = ("kind", "src_ip", "dst_ip", "client_ip", "domain", "action", "dst_port")
HIDDEN_COLUMNS = ("raw", "raw_json", "run_id", "dedup_key")


def get_events(events: DataFrame, limit: int | None = 20, **filters: Any) -> DataFrame:
    """The latest events for a reader: empty filters mean none, planted events are left out.

    A limit is held between 1 and 200; ``None`` gives all of them.
    """
    unknown = set(filters) - set(DRILL_FILTERS)
    if unknown:
        raise KeyError(f"unknown filters: {', '.join(sorted(unknown))}")
    active = {k: v for k, v in filters.items() if v not in (None, "", 0, "any")}
    rows = scope(events, exclude_sources=[CANARY_SOURCE])
    rows = sample(rows, None if limit is None else max(1, min(limit, 200)), **active)
    return rows.drop(*HIDDEN_COLUMNS)
