"""Landed cloud detection findings (one JSON object per line) to events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.functions.scalars import dedup_key, finding_severity_label
from sentrylake.profile import Profile
from sentrylake.schema import RAW_SCHEMA, conform_events
from sentrylake.sources.common import assign_zones

SOURCE = "aws_guardduty"

_REMOTE = "RemoteIpDetails: struct<IpAddressV4: string>, LocalPortDetails: struct<Port: int>"
# The kinds of action a finding can describe, in the order they are looked at.
ACTIONS = (
    "NetworkConnectionAction", "AwsApiCallAction", "DnsRequestAction", "KubernetesApiCallAction",
    "RdsLoginAttemptAction",
)
FINDING_SCHEMA = (
    "Id string, Type string, Severity double, Title string, Description string, "
    "AccountId string, Region string, CreatedAt string, UpdatedAt string, "
    "Resource struct<ResourceType: string, InstanceDetails: struct<InstanceId: string, "
    "NetworkInterfaces: array<struct<PrivateIpAddress: string>>>, "
    "AccessKeyDetails: struct<UserName: string, PrincipalId: string, AccessKeyId: string>>, "
    "Service struct<Count: bigint, EventFirstSeen: string, EventLastSeen: string, "
    "AdditionalInfo: struct<Sample: boolean>, Action: struct<"
    + ", ".join(f"{a}: struct<{_REMOTE}, Domain: string>" for a in ACTIONS)
    + f", PortProbeAction: struct<PortProbeDetails: array<struct<{_REMOTE}>>>>>"
)


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FINDING_SCHEMA).json(path)


def normalize_guardduty(findings: DataFrame, profile: Profile) -> DataFrame:
    """One event per finding version; undated findings are dropped."""
    score = F.coalesce("Severity", F.lit(0.0))
    sample = F.coalesce("Service.AdditionalInfo.Sample", F.lit(False)) | F.coalesce(
        F.col("Title").startswith("[SAMPLE]"), F.lit(False)
    )
    probe = F.get("Service.Action.PortProbeAction.PortProbeDetails", F.lit(0))
    none_if_empty = lambda c: F.nullif(F.col(c), F.lit(""))
    remote = F.coalesce(
        *[none_if_empty(f"Service.Action.{a}.RemoteIpDetails.IpAddressV4") for a in ACTIONS],
        probe["RemoteIpDetails"]["IpAddressV4"],
    )
    port = F.coalesce(
        *[F.nullif(F.col(f"Service.Action.{a}.LocalPortDetails.Port"), F.lit(0)) for a in ACTIONS],
        probe["LocalPortDetails"]["Port"],
    )
    domain = F.coalesce(*[none_if_empty(f"Service.Action.{a}.Domain") for a in ACTIONS])
    kind = F.coalesce(none_if_empty("Type"), F.lit("unknown"))
    account, region = F.coalesce("AccountId", F.lit("")), F.coalesce("Region", F.lit(""))
    raw = {
        "finding_id": F.col("Id"),
        "finding_type": kind,
        "score": score,
        "sample": sample,
        "count": F.col("Service.Count"),
        "resource_type": F.col("Resource.ResourceType"),
        "instance_id": F.col("Resource.InstanceDetails.InstanceId"),
        "access_key_id": F.col("Resource.AccessKeyDetails.AccessKeyId"),
        "description": F.coalesce("Description", F.lit("")),
        "first_seen": F.col("Service.EventFirstSeen"),
        "last_seen": F.col("Service.EventLastSeen"),
        "account": account,
        "region": region,
    }
    rows = findings.select(
        F.try_to_timestamp(F.coalesce(none_if_empty("UpdatedAt"), F.col("CreatedAt"))).alias("ts"),
        F.lit(SOURCE).alias("source"),
        F.lit("ids").alias("kind"),
        dedup_key(SOURCE, F.col("Id"), F.col("UpdatedAt")).alias("dedup_key"),
        F.lit("gd_finding").alias("action"),
        kind.alias("program"),
        finding_severity_label(score).alias("severity"),
        F.coalesce(none_if_empty("Title"), kind).alias("message"),
        F.coalesce(
            none_if_empty("Resource.AccessKeyDetails.UserName"),
            none_if_empty("Resource.AccessKeyDetails.PrincipalId"),
        ).alias("user"),
        F.concat(account, F.lit("/"), region).alias("device"),
        domain.alias("domain"),
        port.alias("dst_port"),
        remote.alias("src_ip"),
        F.get("Resource.InstanceDetails.NetworkInterfaces", F.lit(0))["PrivateIpAddress"].alias("dst_ip"),
        F.lit(None).cast("string").alias("client_ip"),
        F.struct(
            *[
                raw.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
                for f in RAW_SCHEMA.fields
            ]
        ).alias("raw"),
    ).where(F.col("ts").isNotNull())
    return conform_events(assign_zones(rows, profile).withColumn("raw_json", F.to_json("raw")))
