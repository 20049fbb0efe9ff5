"""Landed resolver query logs to events.

Landing layout: JSON pages ``{recordsFiltered, earliest_timestamp, queries: [...]}`` below a folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.functions.domains import clean_domain
from sentrylake.functions.scalars import dedup_key
from sentrylake.profile import Profile
from sentrylake.schema import conform_events
from sentrylake.sources.common import assign_zones, dedup_events, whole_files

SOURCE = "resolver"

# Statuses that mean a lookup was blocked, and those not settled yet.
BLOCKED_STATUSES = (
    "GRAVITY", "GRAVITY_CNAME", "DENYLIST", "DENYLIST_CNAME",
    "REGEX", "REGEX_CNAME", "SPECIAL_DOMAIN", "EXTERNAL_BLOCKED_IP",
    "EXTERNAL_BLOCKED_NULL", "EXTERNAL_BLOCKED_NXRA",
)
TRANSIENT_STATUSES = ("IN_PROGRESS",)

# ``client`` and ``upstream`` are an object or a plain string: read as text, told apart below.
PAGE_SCHEMA = (
    "recordsFiltered bigint, earliest_timestamp double, queries array<struct<id: bigint, "
    "time: string, domain: string, type: string, status: string, client: string, upstream: string>>"
)


def read_dns_landing(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed query, with its ingest order."""
    pages = whole_files(spark).schema(PAGE_SCHEMA).json(path)
    return pages.select(
        F.col("_metadata.file_path").alias("file"), F.posexplode("queries").alias("pos", "q")
    ).select("file", "pos", "q.*")


def object_or_text(raw: Column, first: str, second: str) -> Column:
    """A field of a JSON object by preference, or the text itself when it is no object."""
    parsed = F.from_json(raw, "ip string, name string")
    value = F.coalesce(
        F.nullif(parsed.getField(first), F.lit("")), F.nullif(parsed.getField(second), F.lit(""))
    )
    return F.when(F.ltrim(raw).startswith("{"), value).otherwise(F.nullif(raw, F.lit("")))


def normalize_dns_queries(queries: DataFrame, profile: Profile, source: str = SOURCE) -> DataFrame:
    """Events of query rows: the last copy of an id wins, unsettled and undated queries are dropped."""
    order = [c for c in ("file", "pos") if c in queries.columns] or ["id"]
    rows = dedup_events(queries.where(F.col("id").isNotNull()), order, keep="last", key="id")
    status = F.upper(F.coalesce("status", F.lit("")))
    seconds = F.col("time").cast("string").try_cast("double")
    rows = rows.where(seconds.isNotNull() & ~F.isnan(seconds) & ~status.isin(*TRANSIENT_STATUSES))
    client = object_or_text(F.col("client"), "ip", "name")
    events = rows.select(
        F.timestamp_micros((seconds * 1_000_000).cast("bigint")).alias("ts"),
        F.lit(source).alias("source"),
        F.lit("dns").alias("kind"),
        dedup_key(source, F.col("id")).alias("dedup_key"),
        clean_domain("domain").alias("domain"),
        F.nullif(F.col("type"), F.lit("")).alias("qtype"),
        status.isin(*BLOCKED_STATUSES).alias("blocked"),
        F.nullif(status, F.lit("")).alias("block_reason"),
        object_or_text(F.col("upstream"), "name", "ip").alias("upstream"),
        client.alias("client_ip"),
        F.lit(None).cast("string").alias("src_ip"),
        F.lit(None).cast("string").alias("dst_ip"),
    )
    return conform_events(assign_zones(events, profile))


def load_dns(spark: SparkSession, path: str, profile: Profile) -> DataFrame:
    return normalize_dns_queries(read_dns_landing(spark, path), profile)
