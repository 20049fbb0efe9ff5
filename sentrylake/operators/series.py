"""Ordered analytics: periodicity, sliding distinct counts, hourly shape, TTL ladders, peers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.operators import query as q
from sentrylake.session import materialize

# What makes a series of timestamps periodic.
MIN_SAMPLES = 12
MIN_SPAN_HOURS = 3.0
MAX_CV = 0.18
MIN_INTERVAL_S = 30.0
MAX_INTERVAL_S = 7200.0

# A traceroute's ladder of TTLs.
LADDER_MAX_TTL = 30
LADDER_MAX_START = 3
LADDER_MIN_HOPS = 4

DEAUTH_WINDOW_S = 300


def beacon_scores(
    events: DataFrame,
    keys: Sequence[str],
    *,
    min_samples: int = MIN_SAMPLES,
    min_span_hours: float = MIN_SPAN_HOURS,
    max_cv: float = MAX_CV,
    min_interval_s: float = MIN_INTERVAL_S,
    max_interval_s: float = MAX_INTERVAL_S,
) -> DataFrame:
    """Periodic series among the groups ``keys`` of ``events``.

    Two steps. Counting distinct instants per group needs no order, and the positive gaps of a
    sorted series sum to its span, so the sample, span and mean-gap tests are plain aggregates with
    a map-side combine. Only groups that pass are sorted, and those are small whatever the input
    holds: a mean gap of at least ``min_interval_s`` bounds their distinct instants by
    ``span / min_interval_s``. The passing groups are written in between, so that the second step
    reads only their events and the first is not repeated.
    """
    keys = list(keys)
    instants = (
        events.where(F.col("ts").isNotNull())
        .groupBy(*keys, F.unix_micros("ts").alias("_us"))
        .agg(F.count("*").alias("_n"))
    )
    span_s = (F.col("_last") - F.col("_first")) / 1e6
    shapes = (
        instants.groupBy(*keys)
        .agg(
            F.sum("_n").alias("samples"),
            F.count("*").alias("_distinct"),
            F.min("_us").alias("_first"),
            F.max("_us").alias("_last"),
        )
        .withColumn("gaps", F.col("_distinct") - 1)
        .withColumn("interval_seconds", F.try_divide(span_s, F.col("gaps")))
        .where(
            (F.col("samples") >= min_samples)
            & (span_s >= min_span_hours * 3600)
            & (F.col("gaps") >= min_samples - 1)
            & F.col("interval_seconds").between(min_interval_s, max_interval_s)
        )
        .withColumn("span_hours", span_s / 3600)
        .drop("_distinct", "_first", "_last")
    )
    shapes = materialize(shapes, "series")
    order = Window.partitionBy(*keys).orderBy("_us")
    gaps = (
        instants.join(shapes.select(*keys), keys, "left_semi")
        .withColumn("_gap", (F.col("_us") - F.lag("_us").over(order)) / 1e6)
        .groupBy(*keys)
        .agg(F.stddev_pop("_gap").alias("jitter_seconds"))
    )
    cv = F.col("jitter_seconds") / F.col("interval_seconds")
    tightness = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("cv") / max_cv)
    periods = F.least(F.lit(1.0), F.col("gaps") / 60.0)
    return (
        shapes.join(gaps, keys)
        .withColumn("cv", cv)
        .where(F.col("cv") <= max_cv)
        .withColumn("confidence", 0.45 + 0.5 * (0.6 * tightness + 0.4 * periods))
        .drop("gaps")
    )


def widest_window(
    events: DataFrame, member: str, *, window_s: int = DEAUTH_WINDOW_S, list_limit: int = 20
) -> DataFrame:
    """The span of ``window_s`` seconds with most distinct members: start, count, first members.

    A member seen at second ``t`` is in every window that ends between ``t`` and ``t + window_s``.
    Overlapping stays of one member are merged, each merged stay adds one at its start and takes
    one away after its end, and the running total of those steps is the number of distinct members.
    Rows collapse to one per member and second, then to one per second, before anything is ordered;
    the running total is taken within days and carried over day totals, so no task sees it all.
    """
    seen = (
        events.where(F.col("ts").isNotNull() & (F.coalesce(F.col(member), F.lit("")) != ""))
        .select(F.col(member).alias("member"), F.unix_seconds("ts").alias("sec"))
        .distinct()
    )
    mine = Window.partitionBy("member").orderBy("sec")
    stays = (
        seen.withColumn("_new", (F.col("sec") - F.lag("sec", 1).over(mine)) > window_s)
        .withColumn("_new", F.coalesce(F.col("_new"), F.lit(True)).cast("int"))
        .withColumn("_stay", F.sum("_new").over(mine))
        .groupBy("member", "_stay")
        .agg(F.min("sec").alias("enter"), (F.max("sec") + window_s + 1).alias("leave"))
    )
    steps = (
        stays.select(
            F.explode(
                F.array(
                    F.struct(F.col("enter").alias("sec"), F.lit(1).alias("step")),
                    F.struct(F.col("leave").alias("sec"), F.lit(-1).alias("step")),
                )
            ).alias("s")
        )
        .groupBy("s.sec")
        .agg(F.sum("s.step").alias("step"))
        .withColumn("day", F.floor(F.col("sec") / 86400))
    )
    days = steps.groupBy("day").agg(F.sum("step").alias("total"))
    # One row per day of data: carrying totals over days is a short list.
    carried = days.withColumn(
        "base",
        F.coalesce(
            F.sum("total").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ),
    ).drop("total")
    running = Window.partitionBy("day").orderBy("sec")
    best = (
        steps.join(carried, "day")
        .withColumn("members", F.col("base") + F.sum("step").over(running))
        .orderBy(F.desc("members"), "sec")
        .limit(1)
        .select(F.col("sec").alias("end_sec"), "members")
    )
    end = best.select("end_sec").scalar()
    inside = seen.where((F.col("sec") <= end) & (F.col("sec") >= end - window_s))
    start = inside.agg(F.min("sec")).scalar()
    names = inside.select("member").distinct().orderBy("member").limit(list_limit)
    listed = names.agg(F.sort_array(F.collect_list("member"))).scalar()
    return best.select(
        F.timestamp_seconds(start).alias("window_start"),
        F.col("members").cast("bigint").alias("distinct_members"),
        listed.alias("member_list"),
    )


def hourly_shape(hours: DataFrame) -> DataFrame:
    """Median, mean and peak over hourly counts (columns ``hour, n``); earliest hour on ties."""
    return hours.agg(
        F.count("*").alias("hours_observed"),
        F.median("n").alias("median_hourly"),
        F.avg("n").alias("mean_hourly"),
        F.max_by("hour", F.struct("n", -F.unix_seconds("hour"))).alias("peak_hour"),
        F.max("n").alias("peak_count"),
    )


def peer_mean(values: DataFrame, measure: str) -> Column:
    """Mean of a measure over all other rows, from one scalar total; 0 for a lone row."""
    totals = values.agg(
        F.struct(F.sum(F.col(measure)).alias("total"), F.count("*").alias("n"))
    ).scalar()
    others = totals["n"] - 1
    mine = F.col(measure).cast("double")
    return F.when(others > 0, (totals["total"].cast("double") - mine) / others).otherwise(0.0)


def top_against_peers(counts: DataFrame, key: str, measure: str) -> DataFrame:
    """The highest row with the median of all other rows and the number of rows."""
    best = counts.orderBy(F.desc(measure), key).limit(1)
    best_key = best.select(key).scalar()
    peers = counts.where(F.col(key) != best_key).agg(F.median(measure)).scalar()
    return best.select(
        key, measure, peers.alias("peer_median"), counts.agg(F.count("*")).scalar().alias("members")
    )


def ladder_length(ttls: Column, max_start: int = LADDER_MAX_START) -> Column:
    """Consecutive values upward from the lowest of a short array; 0 when it starts too high."""
    steps = F.array_sort(F.array_distinct(ttls))
    low = F.array_min(steps)
    # Sorted distinct values minus their index stay at the minimum exactly along the first run.
    run = F.size(F.filter(F.transform(steps, lambda x, i: x - i), lambda d: d == low))
    return F.when(low <= max_start, run).otherwise(F.lit(0))


def ttl_ladders(
    events: DataFrame,
    *,
    max_ttl: int = LADDER_MAX_TTL,
    max_start: int = LADDER_MAX_START,
    min_hops: int = LADDER_MIN_HOPS,
    **filters,
) -> DataFrame:
    """(source, destination, protocol) whose TTLs form a ladder. At most ``max_ttl`` TTLs each."""
    return (
        q.low_ttl_pairs(events, max_ttl, **filters)
        .groupBy("src_ip", "dst_ip", "proto")
        .agg(
            F.min("ttl").alias("ttl_start"),
            F.collect_set("ttl").alias("_ttls"),
            F.sum("n").alias("probes"),
            F.min("first_ts").alias("first_seen"),
            F.max("last_ts").alias("last_seen"),
        )
        .withColumn("hops", ladder_length(F.col("_ttls"), max_start))
        .where(F.col("hops") >= min_hops)
        .drop("_ttls")
    )


_PORTS = 1 << 17


def packed_rank(hits: str, port: str) -> Column:
    """Hits and port as one integer that orders by hits, then by lower port.

    A maximum over integers stays a hash aggregate; over a struct it would need sorted input.
    """
    return F.col(hits) * _PORTS + (F.lit(_PORTS - 1) - F.col(port))


def packed_port(rank: Column) -> Column:
    return (F.lit(_PORTS - 1) - rank % _PORTS).cast("int")


def packed_hits(rank: Column) -> Column:
    return F.shiftright(rank, 17)


def port_concentration(events: DataFrame, **filters) -> DataFrame:
    """Per source: most used destination port, its hits, all hits, and its share of them."""
    ports = q.source_ports(events, **filters)
    ranked = ports.groupBy("src_ip").agg(F.max(packed_rank("n", "dst_port")).alias("_best"))
    rank = F.col("_best")
    best = ranked.select(
        "src_ip", packed_port(rank).alias("top_port"), packed_hits(rank).alias("top_port_hits")
    )
    hits = q.top(events, "src_ip", None, **filters).select(
        F.col("value").alias("src_ip"), F.col("n").alias("hits")
    )
    return best.join(hits, "src_ip").withColumn(
        "port_concentration", F.col("top_port_hits") / F.col("hits")
    )
