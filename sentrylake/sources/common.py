"""Steps shared by all sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from sentrylake.profile import Profile


# Fixed value: what no JSON text can have in it, as NUL stands escaped there.
END_OF_FILE = "\0end of file\0"


def whole_files(spark: SparkSession) -> DataFrameReader:
    """A reader of files that are each one JSON text over any number of lines.

    The option ``multiLine`` parses a file as a stream and reads every number that becomes text again from
    the file, which it opens once more for it. Here a file is one record in memory, and such a number is a
    slice of it.
    """
    return spark.read.option("lineSep", END_OF_FILE)


def assign_zones(events: DataFrame, profile: Profile) -> DataFrame:
    """Zones of both ends; an event without a source takes the zone of its client."""
    return events.withColumns(
        {
            "src_zone": F.coalesce(profile.zone_of("src_ip"), profile.zone_of("client_ip")),
            "dst_zone": profile.zone_of("dst_ip"),
        }
    )


def dedup_events(
    events: DataFrame, order: Sequence[str | Column], *, keep: str = "last", key: str = "dedup_key"
) -> DataFrame:
    """One row per record key: the first or last in ingest order.

    A partial aggregation rather than a window: copies of a key are combined where they are read,
    so a key that makes up a large part of the input never gathers in one task.
    """
    rank = F.struct(*order)
    pick = F.max_by if keep == "last" else F.min_by
    rest = [c for c in events.columns if c != key]
    return (
        events.groupBy(key)
        .agg(pick(F.struct(*rest), rank).alias("_row"))
        .select(key, "_row.*")
        .select(*events.columns)
    )


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first occurrence of a pattern; null when absent or empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
