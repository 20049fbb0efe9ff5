"""The ingest steps as Structured Streaming jobs.

Each job gives on a bounded input the rows its batch counterpart gives. Micro-batches are written to a
``BatchTable``, in which each counts once. Running totals are written in update mode and read back as the
row of a key's last batch; a key's totals only grow, so the last is the largest. State ends with the
watermark in every job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sentrylake.operators.history import entity_structs
from sentrylake.profile import Profile
from sentrylake.sources.syslog import normalize_syslog
from sentrylake.streaming.batches import BatchTable


def read_files(spark: SparkSession, path: str, schema, *, format: str = "parquet", **options) -> DataFrame:
    """A stream over files as they land."""
    return spark.readStream.format(format).schema(schema).options(**options).load(path)


def stream_normalize(lines: DataFrame, profile: Profile) -> DataFrame:
    """Landed lines to events: the batch parser is stateless, so it is the streaming parser too."""
    return normalize_syslog(lines, profile)


def stream_dedup(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Distinct events; a key is remembered for ``delay`` past its event time, so state is bounded."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["dedup_key"])


def stream_hourly_counts(
    events: DataFrame, keys: Sequence[str] = (), delay: str = "1 hour"
) -> DataFrame:
    """Events per hour (and keys)."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 hour").alias("w"), *keys)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("hour"), *keys, "n")
    )


def stream_failure_burst(
    events: DataFrame,
    actions: Sequence[str],
    *,
    window: str = "10 minutes",
    slide: str = "1 minute",
    delay: str = "1 hour",
) -> DataFrame:
    """Failed logons per source in sliding windows."""
    return (
        events.where(F.col("action").isin(*actions) & F.col("src_ip").isNotNull())
        .withWatermark("ts", delay)
        .groupBy(F.window("ts", window, slide).alias("w"), "src_ip")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), "src_ip", "n")
    )


def entity_sightings(events: DataFrame) -> DataFrame:
    """``ts, etype, value`` of every entity an event names."""
    pairs = events.select("ts", F.explode(entity_structs()).alias("e")).select("ts", "e.*")
    return pairs.where(F.coalesce(F.col("value"), F.lit("")) != "")


def stream_entities(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """First and last sighting and occurrences of an entity on each ``day``, as running totals.

    A day's totals leave the state when the watermark passes its end, so the state holds the entities of
    ``delay`` and a day; ``merge_days`` adds days up. Partial results are combined map-side, so a hot entity is
    one row per task before it reaches its state. Events without a time are in no day.
    """
    return (
        entity_sightings(events)
        .withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day").alias("w"), "etype", "value")
        .agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("occurrences"))
        .select(F.col("w.start").alias("day"), "etype", "value", "first_seen", "last_seen", "occurrences")
    )


def merge_days(days: DataFrame) -> DataFrame:
    """Sightings of each entity over all days."""
    return days.groupBy("etype", "value").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("occurrences").alias("occurrences")
    )


def stream_new_entities(events: DataFrame, ttl: str = "30 days", known: DataFrame | None = None) -> DataFrame:
    """The first event time to arrive of each entity: once, until ``ttl`` after it has passed the watermark.

    Afterwards its key has left the state and it counts as new again. Entities of ``known`` (``etype, value``, as
    from an entity store) are never new.
    """
    pairs = entity_sightings(events)
    if known is not None:
        pairs = pairs.join(known.select("etype", "value"), ["etype", "value"], "left_anti")
    return pairs.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["etype", "value"]).select("etype", "value", F.col("ts").alias("first_seen"))


# ----- running a job to the end of what has landed


def append_to(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start an append-only job over everything that has landed."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def batches_to(df: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = (), *, mode: str = "append") -> StreamingQuery:
    """Start a job that writes its batches to the table at ``path``, over everything that has landed."""

    def store(batch: DataFrame, number: int) -> None:
        BatchTable(batch.sparkSession, path, keys).write(batch, number)

    return (
        df.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )


def totals_to(df: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = ()) -> StreamingQuery:
    """Start a running-totals job; with their ``keys`` totals that later batches replace are dropped by packing."""
    return batches_to(df, path, checkpoint, keys, mode="update")


def read_totals(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The latest totals per key."""
    return BatchTable(spark, path, keys).read()
