"""Delivered cloud audit files to events.

Layout: ``<root>/AWSLogs/[<org>/]<account>/CloudTrail/<region>/<Y>/<M>/<D>/*.json.gz``, each file one
JSON object ``{Records: [...]}``.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.functions.net import ip_hex
from sentrylake.functions.scalars import dedup_key
from sentrylake.profile import Profile
from sentrylake.schema import RAW_SCHEMA, conform_events
from sentrylake.sources import auditfiles
from sentrylake.sources.common import assign_zones, dedup_events
from sentrylake.sources.window import Window

SOURCE = "aws_cloudtrail"

# Request parameters that name the resource a call touched, in order.
TARGET_KEYS = (
    "secretId", "name", "names", "bucketName", "userName", "roleName",
    "groupName", "policyArn", "trailName", "detectorId", "functionName",
    "instanceId", "instancesSet", "keyId", "path", "stackName", "stackSetName",
    "hostedZoneId", "id", "environmentName", "instanceName", "providerName",
    "url",
)
DENIED_ERRORS = "(?i)AccessDenied|Unauthorized|Forbidden|NotAuthorized"
# A delivery file can hold events older than its name.
SLACK = timedelta(hours=1)

# Free-form parts are read as JSON text and looked into only where needed.
RECORD_SCHEMA = (
    "eventTime: string, eventSource: string, eventName: string, awsRegion: string, "
    "sourceIPAddress: string, userAgent: string, errorCode: string, errorMessage: string, "
    "eventID: string, eventType: string, readOnly: boolean, recipientAccountId: string, "
    "requestParameters: string, sessionCredentialFromConsole: string, "
    "responseElements: struct<ConsoleLogin: string>, additionalEventData: struct<MFAUsed: string>, "
    "userIdentity: struct<type: string, principalId: string, arn: string, accountId: string, "
    "accessKeyId: string, sessionContext: struct<sessionIssuer: struct<arn: string>, "
    "attributes: struct<mfaAuthenticated: string>>>"
)
_RECORD_TYPE = f"struct<{RECORD_SCHEMA}>"


def scan_cloudtrail(
    spark: SparkSession,
    root: str,
    window: Window,
    *,
    accounts: Sequence[str] = (),
    regions: Sequence[str] = (),
) -> DataFrame:
    """Records of the files that can hold events of the window.

    Folders are pruned by account, region and day before they are listed, files by the time in their name
    before they are opened (``auditfiles``); the session takes filters to such sources from here on.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(auditfiles.AuditFiles)
    reach = Window(window.start - SLACK, window.end + SLACK)
    low, high = reach.literals()
    files = spark.read.format(auditfiles.NAME).load(root).where((F.col("latest") >= low) & (F.col("earliest") <= high))
    if accounts:
        files = files.where(F.col("account").isin(*accounts))
    if regions:
        files = files.where(F.col("region").isin(*regions))
    body = F.from_json("body", f"Records array<{_RECORD_TYPE}>")
    return files.select("file", F.posexplode(body["Records"]).alias("pos", "r")).select("file", "pos", "r.*")


def extract_targets(request: Column | str) -> Column:
    """Names of the resources a request points at: strings and string lists of the listed keys,
    at most twenty, cut to 200 characters."""
    text = F.col(request) if isinstance(request, str) else request
    body = F.try_parse_json(text)
    none = F.array().cast("array<string>")

    def strings(items: Column) -> Column:
        kept = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
        return F.coalesce(F.transform(kept, lambda v: F.variant_get(v, "$", "string")), none)

    def named(body: Column) -> Column:
        parts = []
        for key in TARGET_KEYS:
            value = F.try_variant_get(body, f"$.{key}", "variant")
            kind = F.schema_of_variant(value)
            listed = strings(F.try_variant_get(body, f"$.{key}", "array<variant>"))
            part = F.when(kind == "STRING", F.array(F.try_variant_get(body, f"$.{key}", "string"))).when(
                kind.startswith("ARRAY"), listed
            )
            if key == "instancesSet":
                items = F.try_variant_get(body, f"$.{key}.items", "array<variant>")
                ids = F.transform(items, lambda v: F.try_variant_get(v, "$.instanceId", "string"))
                part = part.when(kind.startswith("OBJECT"), F.filter(ids, lambda v: F.coalesce(v, F.lit("")) != ""))
            parts.append(F.coalesce(part, none))
        return F.concat(*parts)

    is_object = F.schema_of_variant(body).startswith("OBJECT")
    return F.when(is_object, named(body)).otherwise(none)


def request_text(request: Column | str) -> Column:
    """The whole request as compact JSON; null for an empty request."""
    text = F.col(request) if isinstance(request, str) else request
    return F.when(~F.trim(text).isin("", "{}", "null", "[]"), text)


def _given(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(c, F.lit(""))


def normalize_cloudtrail(records: DataFrame, profile: Profile) -> DataFrame:
    """Events of audit records; calls that services make for themselves are left out."""
    utype = F.coalesce("userIdentity.type", F.lit(""))
    order = [c for c in ("file", "pos") if c in records.columns]
    service = F.coalesce(_given(F.split_part(F.coalesce("eventSource", F.lit("")), F.lit("."), F.lit(1))), F.lit("unknown"))
    name = F.coalesce(_given("eventName"), F.lit("unknown"))
    account = F.coalesce(_given("recipientAccountId"), _given("userIdentity.accountId"), F.lit(""))
    issuer = _given("userIdentity.sessionContext.sessionIssuer.arn")
    principal = (
        F.when(utype == "Root", F.concat(F.lit("arn:aws:iam::"), account, F.lit(":root")))
        .when((utype == "AssumedRole") & issuer.isNotNull(), issuer)
        .otherwise(
            F.coalesce(
                _given("userIdentity.arn"),
                F.concat(utype, F.lit(":"), F.coalesce("userIdentity.principalId", F.lit(""))),
            )
        )
    )
    when = F.try_to_timestamp(F.col("eventTime"))
    base = records.where(utype != "AWSService").withColumns(
        {
            "ts": when,
            "_type": utype,
            "_account": account,
            "_region": F.coalesce("awsRegion", F.lit("")),
            "_address": F.coalesce("sourceIPAddress", F.lit("")),
            "_error": F.coalesce("errorCode", F.lit("")),
            "_principal": principal,
            "_name": name,
            "program": F.concat(service, F.lit(":"), name),
        }
    ).where(F.col("ts").isNotNull())
    login = F.col("_name") == "ConsoleLogin"
    passed = (F.col("responseElements.ConsoleLogin") == "Success") & (F.col("_error") == "")
    action = (
        F.when(login, F.when(passed, "aws_login_ok").otherwise("aws_login_fail"))
        .when(F.col("_error") == "", "ok")
        .when(F.col("_error").rlike(DENIED_ERRORS), "denied")
        .otherwise("error")
    )
    actor = F.when(
        F.col("_principal").contains("/"), F.substring_index("_principal", "/", -1)
    ).otherwise(F.col("_principal"))
    message = F.concat(
        "program", F.lit(" by "), actor, F.lit(" from "),
        F.coalesce(_given("_address"), F.lit("unknown")),
        F.when(F.col("_error") != "", F.concat(F.lit(" ("), "_error", F.lit(")"))).otherwise(""),
    )
    raw = {
        "region": F.col("_region"),
        "account": F.col("_account"),
        "source": F.col("_address"),
        "caller_account": F.col("userIdentity.accountId"),
        "event_source": F.col("eventSource"),
        "event_name": F.col("_name"),
        "principal_type": F.col("_type"),
        "principal_arn": F.col("userIdentity.arn"),
        "access_key_id": F.col("userIdentity.accessKeyId"),
        "user_agent": F.coalesce("userAgent", F.lit("")),
        "error_code": _given("_error"),
        "error_message": _given("errorMessage"),
        "read_only": F.col("readOnly"),
        "mfa": F.coalesce(
            _given("additionalEventData.MFAUsed"),
            _given("userIdentity.sessionContext.attributes.mfaAuthenticated"),
        ),
        "targets": extract_targets("requestParameters"),
        "from_console": F.coalesce(
            ~F.lower("sessionCredentialFromConsole").isin("", "false", "0"), F.lit(False)
        ),
        "event_type": F.col("eventType"),
        "request": request_text("requestParameters"),
    }
    rows = base.select(
        "ts",
        F.lit(SOURCE).alias("source"),
        F.when(login, "auth").otherwise("other").alias("kind"),
        dedup_key(
            SOURCE,
            F.coalesce(
                _given("eventID"),
                F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX"), "program", "_principal"),
            ),
        ).alias("dedup_key"),
        action.alias("action"),
        "program",
        F.col("_principal").alias("user"),
        F.concat("_account", F.lit("/"), "_region").alias("device"),
        F.when(F.col("readOnly"), "read").when(~F.col("readOnly"), "write").alias("severity"),
        _given("_error").alias("block_reason"),
        message.alias("message"),
        F.when(ip_hex("_address").isNotNull(), F.col("_address")).alias("src_ip"),
        F.lit(None).cast("string").alias("client_ip"),
        F.lit(None).cast("string").alias("dst_ip"),
        F.struct(
            *[
                raw.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
                for f in RAW_SCHEMA.fields
            ]
        ).alias("raw"),
        *order,
    )
    events = assign_zones(rows, profile).withColumn("raw_json", F.to_json("raw"))
    if not order:
        return conform_events(events)
    return conform_events(dedup_events(events, order, keep="first"))


def service_call_count(records: DataFrame) -> DataFrame:
    """Calls that services made for themselves, which are not kept."""
    return records.agg(F.count_if(F.col("userIdentity.type") == "AWSService").alias("service_calls"))


def load_cloudtrail(
    spark: SparkSession, root: str, window: Window, profile: Profile, **which
) -> DataFrame:
    """Distinct audit events with a time in the half-open window."""
    records = scan_cloudtrail(spark, root, window, **which)
    return normalize_cloudtrail(records, profile).where(window.contains_half_open())
