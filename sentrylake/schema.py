"""Column layout of the event table and of the run products.

Every source is normalised to ``EVENT_SCHEMA`` so that ``src_ip`` or ``domain`` mean the same thing
everywhere. The table is written as Parquet partitioned by ``run_id`` and ``kind``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Typed payload of cloud audit records and cloud findings (null for every other source).
RAW_SCHEMA = T.StructType(
    [
        T.StructField("region", T.StringType()),
        T.StructField("account", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("caller_account", T.StringType()),
        T.StructField("event_source", T.StringType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("principal_type", T.StringType()),
        T.StructField("principal_arn", T.StringType()),
        T.StructField("access_key_id", T.StringType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("error_code", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("read_only", T.BooleanType()),
        T.StructField("mfa", T.StringType()),
        T.StructField("targets", T.ArrayType(T.StringType())),
        T.StructField("from_console", T.BooleanType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("request", T.StringType()),
        T.StructField("finding_id", T.StringType()),
        T.StructField("finding_type", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("sample", T.BooleanType()),
        T.StructField("count", T.LongType()),
        T.StructField("resource_type", T.StringType()),
        T.StructField("instance_id", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("first_seen", T.StringType()),
        T.StructField("last_seen", T.StringType()),
    ]
)

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("source", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("dedup_key", T.StringType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("proto", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("iface_in", T.StringType()),
        T.StructField("iface_out", T.StringType()),
        T.StructField("ttl", T.IntegerType()),
        T.StructField("pkt_len", T.IntegerType()),
        T.StructField("client_ip", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("qtype", T.StringType()),
        T.StructField("blocked", T.BooleanType()),
        T.StructField("block_reason", T.StringType()),
        T.StructField("upstream", T.StringType()),
        T.StructField("device", T.StringType()),
        T.StructField("program", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("src_zone", T.StringType()),
        T.StructField("dst_zone", T.StringType()),
        T.StructField("raw", RAW_SCHEMA),
        T.StructField("raw_json", T.StringType()),
    ]
)

EVENT_COLUMNS = tuple(f.name for f in EVENT_SCHEMA.fields)

ENTITY = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("role", T.StringType()),
    ]
)

SIGNAL_SCHEMA = T.StructType(
    [
        T.StructField("signal_id", T.StringType()),
        T.StructField("analyzer", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("taxonomy", T.StringType()),
        T.StructField("severity_hint", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("entities", T.ArrayType(ENTITY)),
        T.StructField("evidence", T.StringType()),
        T.StructField("is_canary", T.BooleanType()),
    ]
)

METRIC_SCHEMA = T.StructType(
    [
        T.StructField("section", T.StringType()),
        T.StructField("ord", T.IntegerType()),
        T.StructField("key", T.StringType()),
        T.StructField("value_num", T.DoubleType()),
        T.StructField("value_text", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("label", T.StringType()),
    ]
)

FINDING_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("finding_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("title", T.StringType()),
        T.StructField("severity", T.IntegerType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("taxonomy", T.StringType()),
        T.StructField("zone", T.StringType()),
        T.StructField("what", T.StringType()),
        T.StructField("why", T.StringType()),
        T.StructField("not_this", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("signal_ids", T.ArrayType(T.StringType())),
        T.StructField("event_ids", T.ArrayType(T.LongType())),
        T.StructField("evidence_kinds", T.ArrayType(T.StringType())),
        T.StructField("entities", T.ArrayType(ENTITY)),
        T.StructField("suppressed", T.BooleanType()),
        T.StructField("suppressed_reason", T.StringType()),
    ]
)

# Event kinds.
KINDS = ("firewall", "dns", "system", "auth", "ids", "flow", "http", "other")

# Severity names by rank; SUSPECTED is an unrated marker below INFO.
SEVERITIES = {"SUSPECTED": -1, "INFO": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
SUSPECTED, INFO, LOW, MEDIUM, HIGH, CRITICAL = -1, 0, 1, 2, 3, 4

# Trust labels that make a zone a sensitive one.
UNTRUSTED = ("untrusted", "semi-trusted", "dmz", "guest")

# Source name under which planted self-test events are stored.
CANARY_SOURCE = "canary"


def layout(**columns: str | T.DataType) -> T.StructType:
    """A layout by names; types are Spark's, simple ones by name."""
    made = T.StructType()
    for name, kind in columns.items():
        made = made.add(name, kind)
    return made


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema``: cast what is there, add the rest as nulls."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def conform_events(df: DataFrame) -> DataFrame:
    """Give ``df`` exactly the event columns, also when it was written before a column existed."""
    return conform(df, EVENT_SCHEMA)
