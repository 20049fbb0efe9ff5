"""The given tables seen as network telemetry.

Each view is derived from a whole table by expressions that Spark and plain SQL both accept, so
that every registered query runs on the given data and has a SQL text to be compared with.
``VIEWS`` holds the SQL of a view, the methods of ``Tables`` build the same rows as DataFrames.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.operators import history as H
from sentrylake.operators.history import Baseline
from sentrylake.profile import Profile
from sentrylake.schema import FINDING_SCHEMA, conform, conform_events

PROFILE = Profile.parse(
    {
        "site": {"name": "site", "timezone": "America/New_York"},
        "zones": [
            {"name": "lan", "cidrs": ["10.10.0.0/24", "fd00:10::/64"], "trust": "trusted"},
            {
                "name": "iot", "cidrs": ["10.10.50.0/24"], "trust": "untrusted",
                "gateway": "10.10.0.10", "expected_egress_domains": ["*.example.com"],
            },
            {"name": "dmz", "cidrs": ["10.10.15.0/24"], "trust": "semi-trusted", "gateway": "10.10.0.4"},
        ],
        "hosts": [
            {"ip": "10.10.0.1", "name": "edge", "role": "router"},
            {"ip": "10.10.0.69", "role": "resolver"},
            {"ip": "10.10.50.7", "name": "camera"},
        ],
        "policy": {
            "approved_resolvers": ["10.10.0.69"],
            "attack_surface_ports": [22, 23, 445, 3389],
            "nat_attribution_limited_behind": ["10.10.0.10", "10.10.0.4"],
            "benign_domains": ["the.example.com"],
            "benign_domain_suffixes": ["example.org", "local"],
        },
        "cloud_accounts": [
            {
                "account_id": "100000000001",
                "expected_regions": ["us-east-1", "eu-west-1"],
                "blocked_accounts": ["zone-77"],
                "principals": [
                    {"match": "user/u3", "dormant": True, "long_term_keys": False},
                    {"match": "role/r2", "allowed_services": ["s3", "sts"], "allowed_buckets": ["res1", "res2"]},
                ],
                "watched_resources": [{"match": "zone-123", "severity": "MEDIUM", "note": "old record"}],
            },
            {
                "account_id": "100000000002",
                "expected_regions": ["us-west-2"],
                "blocked_accounts": ["zone-77"],
                "principals": [
                    {"match": "user/u8", "long_term_keys": False, "allowed_buckets": ["res5"]},
                    {"match": "user/u3", "dormant": True, "long_term_keys": False},
                    {"match": "role/r2", "allowed_services": ["iam", "sts"], "allowed_buckets": ["res3"]},
                ],
                "watched_resources": [{"match": "zone-45"}, {"match": "zone-123"}],
            },
        ],
    }
)

# Calls that the audit view cycles through.
PROGRAMS = (
    "iam:CreateUser", "iam:AttachRolePolicy", "s3:PutBucketPolicy", "s3:GetObject",
    "s3:ListObjects", "s3:GetBucketAcl", "ec2:RunInstances", "lambda:CreateFunction20150331",
    "route53:ChangeResourceRecordSets", "cloudtrail:StopLogging", "guardduty:UpdateDetector",
    "secretsmanager:GetSecretValue", "ssm:GetParameter", "iam:ListUsers", "iam:GetRole",
    "iam:ListRoles", "sts:AssumeRole", "signin:ConsoleLogin", "kms:DisableKey", "s3:PutObject",
    "ec2:DescribeInstances", "logs:DeleteLogGroup", "cloudfront:UpdateDistribution",
    "iam:ListPolicies",
)
REGIONS = ("us-east-1", "eu-west-1", "us-west-2", "ap-south-1")

# Reference time of history queries, and the instant that splits a table into two runs.
AS_OF = "1998-06-01 00:00:00"
SPLIT = "1998-01-01 00:00:00"
DNS_SPLIT = "2024-01-16 00:00:00"


def zone_sql(ip: str) -> str:
    return (
        f"CASE WHEN {ip} IS NULL THEN NULL WHEN starts_with({ip}, '10.10.0.') THEN 'lan' "
        f"WHEN starts_with({ip}, '10.10.50.') THEN 'iot' WHEN starts_with({ip}, '10.10.15.') "
        f"THEN 'dmz' WHEN starts_with({ip}, '10.') THEN 'private' ELSE 'external' END"
    )


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


VIEWS = {
    "fw": """SELECT id, ts, src_ip, src_port, dst_ip, dst_port, proto, action, iface_in, ttl, pkt_len, device,
    dedup_key, {src_zone} AS src_zone, {dst_zone} AS dst_zone, 'firewall' AS kind, 'syslog' AS source FROM (
  SELECT l_orderkey AS id, l_shipdate + l_linenumber * INTERVAL 1 HOUR AS ts,
    CASE WHEN l_linestatus = 'F' THEN '198.51.' || (100 + l_suppkey % 3) || '.' || (l_suppkey % 250 + 1)
         ELSE '10.10.0.' || (l_suppkey % 50 + 20) END AS src_ip,
    CASE WHEN l_suppkey % 10 = 0 THEN 443 ELSE 40000 + l_orderkey % 1000 END AS src_port,
    CASE WHEN l_partkey % 2 = 0 THEN '203.0.113.' || (l_partkey % 200) ELSE '10.10.50.' || (l_partkey % 200) END AS dst_ip,
    CASE l_partkey % 4 WHEN 0 THEN 22 WHEN 1 THEN 443 WHEN 2 THEN (CASE WHEN l_partkey % 8 = 2 THEN 53 ELSE 3389 END)
         ELSE 1024 + l_partkey % 30 END AS dst_port,
    CASE l_returnflag WHEN 'N' THEN 'drop' WHEN 'A' THEN 'accept' ELSE 'reject' END AS action,
    CASE WHEN l_linenumber % 2 = 0 THEN 'udp' ELSE 'tcp' END AS proto,
    'eth' || (l_suppkey % 3) AS iface_in, (l_linenumber + 1) // 2 AS ttl, CAST(l_quantity * 30 AS INTEGER) AS pkt_len,
    CAST(l_suppkey % 5 + 1 AS VARCHAR) AS device, 'fw:' || l_orderkey || ':' || l_linenumber AS dedup_key
  FROM lineitem)""".format(src_zone=zone_sql("src_ip"), dst_zone=zone_sql("dst_ip")),
    "dns": """SELECT *, {zone} AS src_zone, 'dns' AS kind, 'resolver' AS source FROM (
  SELECT event_id AS id, ts, CASE user_id % 3 WHEN 0 THEN '10.10.0.' WHEN 1 THEN '10.10.50.' ELSE '10.10.15.' END
      || (user_id % 250 + 1) AS client_ip,
    CASE WHEN user_id % 25 = 3 AND event_type = 'view' THEN md5(CAST(event_id AS VARCHAR)) || '.x.tunnel.example.net'
         ELSE regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) END AS domain,
    CASE WHEN value < 5 THEN 'TXT' ELSE 'A' END AS qtype, event_type = 'error' AS blocked,
    CASE event_type WHEN 'error' THEN 'GRAVITY' WHEN 'signup' THEN 'NXDOMAIN' ELSE 'FORWARDED' END AS block_reason,
    'dns:' || event_id AS dedup_key
  FROM events JOIN pages ON page_id = event_id % (SELECT count(*) FROM pages))""".format(zone=zone_sql("client_ip")),
    "ssh": """SELECT *, {zone} AS src_zone, 'auth' AS kind, 'syslog' AS source FROM (
  SELECT o_orderkey AS id, o_orderdate AS ts, 'acct' || (o_custkey % 40) AS "user",
    CASE o_orderstatus WHEN 'F' THEN 'ssh_failed' WHEN 'O' THEN 'ssh_accepted' ELSE 'ssh_invalid' END AS action,
    CASE WHEN o_custkey % 7 = 0 THEN '203.0.113.' ELSE '10.10.0.' END || (o_custkey % 100 + 1) AS src_ip,
    CASE WHEN o_orderkey % 2 = 0 THEN 'password' ELSE 'publickey' END AS proto,
    CAST(o_custkey % 9 AS VARCHAR) AS device, 'SSHD' AS program, 'ssh:' || o_orderkey AS dedup_key
  FROM orders)""".format(zone=zone_sql("src_ip")),
    "win": """SELECT *, {zone} AS src_zone, 'auth' AS kind, 'syslog' AS source FROM (
  SELECT o_orderkey AS id, o_orderdate + INTERVAL 1 HOUR AS ts, 'win' || (o_custkey % 33) AS "user",
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'lockout' WHEN '2' THEN 'logon_failed' WHEN '3' THEN 'logon_success'
         WHEN '4' THEN 'privileged' ELSE 'explicit_creds' END AS action,
    CASE WHEN o_custkey % 6 = 0 THEN '203.0.113.' ELSE '10.10.15.' END || (o_custkey % 90 + 1) AS src_ip,
    CASE o_custkey % 4 WHEN 0 THEN 'rdp' WHEN 1 THEN 'network' WHEN 2 THEN 'interactive' ELSE 'service' END AS proto,
    CAST(o_custkey % 9 AS VARCHAR) AS device, 'MICROSOFT-WINDOWS-SECURITY-AUDIT' AS program, 'win:' || o_orderkey AS dedup_key
  FROM orders)""".format(zone=zone_sql("src_ip")),
    "web": """SELECT *, {zone} AS src_zone, 'auth' AS kind, 'syslog' AS source FROM (
  SELECT o_orderkey AS id, o_orderdate + INTERVAL 2 HOUR AS ts, CASE WHEN o_custkey % 2 = 0 THEN 'root' END AS "user",
    CASE o_orderstatus WHEN 'F' THEN 'web_login_failed' ELSE 'web_login_success' END AS action,
    CASE WHEN o_custkey % 10 = 0 THEN '198.51.100.' ELSE '10.10.0.' END || (o_custkey % 60 + 1) AS src_ip,
    CAST(o_custkey % 9 AS VARCHAR) AS device, 'UHTTPD' AS program, 'web:' || o_orderkey AS dedup_key
  FROM orders)""".format(zone=zone_sql("src_ip")),
    "wifi": """SELECT event_id AS id, ts, CASE WHEN event_type = 'purchase' THEN 'VPNSERVER1' ELSE 'HOSTAPD' END AS program,
    CASE WHEN event_type <> 'purchase' THEN 'deauth' END AS action,
    CASE WHEN event_type <> 'purchase' THEN '02:00:00:00:00:' || lpad(lower(to_hex(user_id % 256)), 2, '0') END AS "user",
    CASE WHEN event_type = 'error' THEN 'emerg' ELSE 'info' END AS severity, 'wifi:' || event_id AS dedup_key,
    'auth' AS kind, 'syslog' AS source FROM events""",
    "ids": """SELECT c_custkey AS id, TIMESTAMP '2024-01-01 00:00:00' + c_custkey * INTERVAL 1 SECOND AS ts,
    CAST(c_nationkey AS VARCHAR) AS device, 'detected on ' || c_name AS message, 'detection' AS action,
    'ids:' || c_custkey AS dedup_key, 'ids' AS kind, 'syslog' AS source FROM customer""",
    "cloud": """SELECT *, CASE WHEN root THEN 'arn:aws:iam::' || account || ':root'
      WHEN cust % 5 = 0 THEN 'arn:aws:iam::' || account || ':role/r' || (cust % 7)
      ELSE 'arn:aws:iam::' || account || ':user/u' || (cust % 30) END AS "user",
    account || '/' || region AS device,
    CASE WHEN cust % 13 = 0 THEN 'AWSAccount' WHEN root THEN 'Root' WHEN cust % 5 = 0 THEN 'AssumedRole' ELSE 'IAMUser' END AS principal_type,
    CASE WHEN cust % 13 = 0 THEN '999999999999' ELSE account END AS caller_account,
    CASE WHEN program = 'signin:ConsoleLogin' THEN 'auth' ELSE 'other' END AS kind,
    CASE WHEN program = 'signin:ConsoleLogin' THEN (CASE st WHEN 'O' THEN 'aws_login_ok' ELSE 'aws_login_fail' END)
      ELSE (CASE st WHEN 'O' THEN 'ok' WHEN 'F' THEN 'denied' ELSE 'error' END) END AS action,
    'aws_cloudtrail' AS source FROM (
  SELECT o_orderkey AS id, o_orderdate + (o_orderkey % 24) * INTERVAL 1 HOUR AS ts, o_custkey AS cust, o_orderstatus AS st,
    CAST(100000000000 + c_nationkey % 5 AS VARCHAR) AS account, {regions}[c_nationkey % 4 + 1] AS region,
    {programs}[(o_orderkey * 7 + o_custkey) % {n} + 1] AS program, o_custkey % 97 = 0 AS root,
    CASE WHEN o_custkey % 11 <> 0 THEN '203.0.113.' || (o_custkey % 50) END AS src_ip,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'write' ELSE 'read' END AS severity,
    CASE WHEN o_custkey % 2 = 0 THEN 'No' ELSE 'Yes' END AS mfa, ['res' || (o_orderkey % 60), 'a/b' || (o_custkey % 9)] AS targets,
    o_custkey % 3 = 0 AS from_console, CASE WHEN o_custkey % 4 = 0 THEN 'AKIA' ELSE 'ASIA' END || o_custkey AS access_key_id,
    'agent/' || (o_custkey % 6) AS user_agent, CASE o_orderstatus WHEN 'F' THEN 'AccessDenied' WHEN 'P' THEN 'Throttling' END AS error_code,
    'zone-' || (o_orderkey % 500) AS request, '{{"request":"zone-' || (o_orderkey % 500) || '"}}' AS raw_json,
    'ct:' || o_orderkey AS dedup_key
  FROM orders JOIN customer ON o_custkey = c_custkey)""".format(
        regions=_list(REGIONS), programs=_list(PROGRAMS), n=len(PROGRAMS)
    ),
    "findings": """SELECT 'run' || (o_orderkey % 20) AS run_id, 'F' || o_orderkey AS finding_id, o_orderdate AS ts,
    'About ' || o_orderpriority AS title, o_custkey % 5 AS severity,
    ['scan.persistent_prober', 'c2.beacon_candidate', 'recon.internal_traceroute', 'dns.tunnel_suspect'][o_custkey % 4 + 1] AS taxonomy,
    ['198.51.' || (100 + (o_custkey % 100 + 1) % 3) || '.' || ((o_custkey % 100 + 1) % 250 + 1), '10.10.0.' || (o_custkey % 50 + 20)] AS named
  FROM orders""",
    "metrics": """SELECT 'run' || (o_orderkey % 20) AS run_id, o_orderdate AS ts,
    ['zone.lan.daypart.night', 'zone.iot.daypart.morning', 'zone.iot.daypart.evening', 'zone.lan.daypart.afternoon', 'fw.drops'][o_custkey % 5 + 1] AS key,
    CASE WHEN o_custkey % 5 <> 4 THEN (o_orderkey % 8)::DOUBLE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS value_num,
    CASE WHEN o_custkey % 5 = 4 AND o_orderkey % 3 = 0 THEN 'n/a' END AS value_text FROM orders""",
    "watchlist": """SELECT ['ip', 'host', 'domain', 'host'][s_suppkey % 4 + 1] AS entity_type,
    CASE WHEN s_suppkey % 4 = 2 THEN 'the.example.com' WHEN s_suppkey % 8 = 3 THEN CAST(s_suppkey % 5 + 1 AS VARCHAR)
      ELSE '10.10.' || CASE WHEN s_suppkey % 8 < 4 THEN '0.' ELSE '50.' END || (s_suppkey % 60 + 1) END AS entity_value, s_name AS reason,
    CASE WHEN s_suppkey % 3 > 0 THEN TIMESTAMP '1998-05-01 00:00:00' + s_suppkey * INTERVAL 1 DAY END AS expires_at FROM supplier""",
    "iocs": """SELECT '203.0.113.' || s_suppkey AS value, 'ip' AS kind, 4 - s_suppkey % 4 AS severity, ['T1','T2','T3','T4'][s_suppkey % 4 + 1] AS tier,
    s_name AS source FROM supplier
  UNION ALL SELECT CASE n_nationkey % 3 WHEN 0 THEN '198.51.100.' || (n_nationkey * 8) || '/29' WHEN 1 THEN '203.0.113.' || (n_nationkey * 8) || '/30'
    ELSE '198.' || (n_nationkey + 30) || '.0.0/15' END, 'cidr', 4 - n_nationkey % 4, ['T1','T2','T3','T4'][n_nationkey % 4 + 1], n_name FROM nation
  UNION ALL SELECT value, kind, 4 - min(p) % 4, ['T1','T2','T3','T4'][min(p) % 4 + 1], 'pages' FROM (
    SELECT CASE WHEN p % 2 = 0 THEN host ELSE regexp_extract(host, '([^.]+\\.[^.]+)$', 1) END AS value,
      CASE WHEN p % 2 = 0 THEN 'domain' ELSE 'domain_suffix' END AS kind, p
    FROM (SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, min(page_id) AS p FROM pages GROUP BY 1)) GROUP BY value, kind""",
    "gd": """SELECT p_partkey AS id, TIMESTAMP '2024-01-01 00:00:00' + p_partkey * INTERVAL 1 MINUTE AS ts, p_type AS program,
    p_size / 5.0 AS score, CASE WHEN p_size >= 45 THEN 'CRITICAL' WHEN p_size >= 35 THEN 'HIGH' WHEN p_size >= 20 THEN 'MEDIUM'
      ELSE 'LOW' END AS severity, p_name AS message, p_brand LIKE '%1' AS sample,
    CASE WHEN p_size % 3 = 0 THEN 'i-' || (p_size % 10) END AS instance_id, 'Instance' AS resource_type,
    'about ' || p_name AS description, 'acct' || (p_size % 4) AS "user", '100000000001/us-east-1' AS device,
    'gd:' || p_partkey AS dedup_key, 'ids' AS kind, 'aws_guardduty' AS source FROM part""",
}


def with_views(names: str, body: str) -> str:
    """``body`` with the named views (space separated) defined in front of it."""
    parts = [f"{n} AS ({VIEWS[n]})" for n in names.split()]
    rest = body.strip()
    if rest.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + rest[5:]
    return "WITH " + ",\n".join(parts) + "\n" + rest


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


class Tables:
    """The given tables of one scale factor, raw and as telemetry views."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.profile = PROFILE

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _zones(self, df: DataFrame, src: str, dst: str | None = None) -> DataFrame:
        df = df.withColumn("src_zone", self.profile.zone_of(src))
        return df if dst is None else df.withColumn("dst_zone", self.profile.zone_of(dst))

    @cached_property
    def fw(self) -> DataFrame:
        li = self.raw("lineitem")
        part, supp = F.col("l_partkey"), F.col("l_suppkey")
        text = lambda c: c.cast("string")
        rows = li.select(
            F.col("l_orderkey").alias("id"),
            F.timestamp_add("HOUR", "l_linenumber", F.col("l_shipdate").cast("timestamp")).alias("ts"),
            F.when(
                F.col("l_linestatus") == "F",
                F.concat(F.lit("198.51."), text(supp % 3 + 100), F.lit("."), text(supp % 250 + 1)),
            ).otherwise(F.concat(F.lit("10.10.0."), text(supp % 50 + 20))).alias("src_ip"),
            F.when(supp % 10 == 0, 443).otherwise(F.col("l_orderkey") % 1000 + 40000).cast("int").alias("src_port"),
            F.when(part % 2 == 0, F.concat(F.lit("203.0.113."), text(part % 200)))
            .otherwise(F.concat(F.lit("10.10.50."), text(part % 200))).alias("dst_ip"),
            F.when(part % 4 == 0, 22).when(part % 4 == 1, 443).when(part % 8 == 2, 53)
            .when(part % 4 == 2, 3389).otherwise(part % 30 + 1024).cast("int").alias("dst_port"),
            F.when(F.col("l_returnflag") == "N", "drop").when(F.col("l_returnflag") == "A", "accept")
            .otherwise("reject").alias("action"),
            F.when(F.col("l_linenumber") % 2 == 0, "udp").otherwise("tcp").alias("proto"),
            F.concat(F.lit("eth"), text(supp % 3)).alias("iface_in"),
            ((F.col("l_linenumber") + 1) / 2).cast("int").alias("ttl"),
            (F.col("l_quantity") * 30).cast("int").alias("pkt_len"),
            text(supp % 5 + 1).alias("device"),
            F.concat(F.lit("fw:"), text(F.col("l_orderkey")), F.lit(":"), text(F.col("l_linenumber"))).alias("dedup_key"),
            F.lit("firewall").alias("kind"), F.lit("syslog").alias("source"),
        )
        return conform_events(self._zones(rows, "src_ip", "dst_ip"))

    @cached_property
    def dns(self) -> DataFrame:
        pages = self.raw("pages")
        n = pages.agg(F.count("*")).scalar()
        user, kind = F.col("user_id"), F.col("event_type")
        ev = self.raw("events").withColumn("page_id", F.col("event_id") % n)
        host = F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
        rows = ev.join(pages.select("page_id", "url"), "page_id").select(
            F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"),
            F.concat(
                F.when(user % 3 == 0, "10.10.0.").when(user % 3 == 1, "10.10.50.").otherwise("10.10.15."),
                (user % 250 + 1).cast("string"),
            ).alias("client_ip"),
            F.when(
                (user % 25 == 3) & (kind == "view"),
                F.concat(F.md5(F.col("event_id").cast("string")), F.lit(".x.tunnel.example.net")),
            ).otherwise(host).alias("domain"),
            F.when(F.col("value") < 5, "TXT").otherwise("A").alias("qtype"),
            (kind == "error").alias("blocked"),
            F.when(kind == "error", "GRAVITY").when(kind == "signup", "NXDOMAIN").otherwise("FORWARDED").alias("block_reason"),
            F.concat(F.lit("dns:"), F.col("event_id").cast("string")).alias("dedup_key"),
            F.lit("dns").alias("kind"), F.lit("resolver").alias("source"),
        )
        return conform_events(self._zones(rows, "client_ip"))

    def _orders(self, hours: int = 0) -> DataFrame:
        return self.raw("orders").withColumn(
            "ts", F.timestamp_add("HOUR", F.lit(hours), F.col("o_orderdate").cast("timestamp"))
        )

    @cached_property
    def ssh(self) -> DataFrame:
        cust = F.col("o_custkey")
        rows = self._orders().select(
            F.col("o_orderkey").alias("id"), "ts", F.concat(F.lit("acct"), (cust % 40).cast("string")).alias("user"),
            F.when(F.col("o_orderstatus") == "F", "ssh_failed").when(F.col("o_orderstatus") == "O", "ssh_accepted")
            .otherwise("ssh_invalid").alias("action"),
            F.concat(F.when(cust % 7 == 0, "203.0.113.").otherwise("10.10.0."), (cust % 100 + 1).cast("string")).alias("src_ip"),
            F.when(F.col("o_orderkey") % 2 == 0, "password").otherwise("publickey").alias("proto"),
            (cust % 9).cast("string").alias("device"), F.lit("SSHD").alias("program"),
            F.concat(F.lit("ssh:"), F.col("o_orderkey").cast("string")).alias("dedup_key"),
            F.lit("auth").alias("kind"), F.lit("syslog").alias("source"),
        )
        return conform_events(self._zones(rows, "src_ip"))

    @cached_property
    def win(self) -> DataFrame:
        cust, level = F.col("o_custkey"), F.substring("o_orderpriority", 1, 1)
        rows = self._orders(1).select(
            F.col("o_orderkey").alias("id"), "ts", F.concat(F.lit("win"), (cust % 33).cast("string")).alias("user"),
            F.when(level == "1", "lockout").when(level == "2", "logon_failed").when(level == "3", "logon_success")
            .when(level == "4", "privileged").otherwise("explicit_creds").alias("action"),
            F.concat(F.when(cust % 6 == 0, "203.0.113.").otherwise("10.10.15."), (cust % 90 + 1).cast("string")).alias("src_ip"),
            _pick(("rdp", "network", "interactive", "service"), cust % 4).alias("proto"),
            (cust % 9).cast("string").alias("device"), F.lit("MICROSOFT-WINDOWS-SECURITY-AUDIT").alias("program"),
            F.concat(F.lit("win:"), F.col("o_orderkey").cast("string")).alias("dedup_key"),
            F.lit("auth").alias("kind"), F.lit("syslog").alias("source"),
        )
        return conform_events(self._zones(rows, "src_ip"))

    @cached_property
    def web(self) -> DataFrame:
        cust = F.col("o_custkey")
        rows = self._orders(2).select(
            F.col("o_orderkey").alias("id"), "ts", F.when(cust % 2 == 0, "root").alias("user"),
            F.when(F.col("o_orderstatus") == "F", "web_login_failed").otherwise("web_login_success").alias("action"),
            F.concat(F.when(cust % 10 == 0, "198.51.100.").otherwise("10.10.0."), (cust % 60 + 1).cast("string")).alias("src_ip"),
            (cust % 9).cast("string").alias("device"), F.lit("UHTTPD").alias("program"),
            F.concat(F.lit("web:"), F.col("o_orderkey").cast("string")).alias("dedup_key"),
            F.lit("auth").alias("kind"), F.lit("syslog").alias("source"),
        )
        return conform_events(self._zones(rows, "src_ip"))

    @cached_property
    def wifi(self) -> DataFrame:
        vpn = F.col("event_type") == "purchase"
        mac = F.concat(F.lit("02:00:00:00:00:"), F.lpad(F.lower(F.hex(F.col("user_id") % 256)), 2, "0"))
        rows = self.raw("events").select(
            F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"),
            F.when(vpn, "VPNSERVER1").otherwise("HOSTAPD").alias("program"),
            F.when(~vpn, "deauth").alias("action"), F.when(~vpn, mac).alias("user"),
            F.when(F.col("event_type") == "error", "emerg").otherwise("info").alias("severity"),
            F.concat(F.lit("wifi:"), F.col("event_id").cast("string")).alias("dedup_key"),
            F.lit("auth").alias("kind"), F.lit("syslog").alias("source"),
        )
        return conform_events(rows)

    @cached_property
    def ids(self) -> DataFrame:
        start = F.lit("2024-01-01 00:00:00").cast("timestamp")
        rows = self.raw("customer").select(
            F.col("c_custkey").alias("id"), F.timestamp_add("SECOND", "c_custkey", start).alias("ts"),
            F.col("c_nationkey").cast("string").alias("device"),
            F.concat(F.lit("detected on "), "c_name").alias("message"), F.lit("detection").alias("action"),
            F.concat(F.lit("ids:"), F.col("c_custkey").cast("string")).alias("dedup_key"),
            F.lit("ids").alias("kind"), F.lit("syslog").alias("source"),
        )
        return conform_events(rows)

    @cached_property
    def cloud(self) -> DataFrame:
        cust, key, st = F.col("o_custkey"), F.col("o_orderkey"), F.col("o_orderstatus")
        text = lambda c: c.cast("string")
        account = text(F.lit(100000000000) + F.col("c_nationkey") % 5)
        region = _pick(REGIONS, F.col("c_nationkey") % 4)
        root = cust % 97 == 0
        foreign = cust % 13 == 0
        zone = F.concat(F.lit("zone-"), text(key % 500))
        program = F.col("program")
        login = program == "signin:ConsoleLogin"
        arn = F.concat(F.lit("arn:aws:iam::"), F.col("account"))
        base = (
            self.raw("orders").join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .withColumns({
                "account": account, "region": region,
                "program": _pick(PROGRAMS, (key * 7 + cust) % len(PROGRAMS)),
                "ts": F.timestamp_add("HOUR", (key % 24).cast("int"), F.col("o_orderdate").cast("timestamp")),
            })
        )
        rows = base.select(
            key.alias("id"), "ts", program.alias("program"),
            F.when(root, F.concat(arn, F.lit(":root"))).when(cust % 5 == 0, F.concat(arn, F.lit(":role/r"), text(cust % 7)))
            .otherwise(F.concat(arn, F.lit(":user/u"), text(cust % 30))).alias("user"),
            F.when(cust % 11 != 0, F.concat(F.lit("203.0.113."), text(cust % 50))).alias("src_ip"),
            F.concat("account", F.lit("/"), "region").alias("device"),
            F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "write").otherwise("read").alias("severity"),
            F.when(login, "auth").otherwise("other").alias("kind"),
            F.when(login, F.when(st == "O", "aws_login_ok").otherwise("aws_login_fail"))
            .otherwise(F.when(st == "O", "ok").when(st == "F", "denied").otherwise("error")).alias("action"),
            F.concat(F.lit('{"request":"'), zone, F.lit('"}')).alias("raw_json"),
            F.concat(F.lit("ct:"), text(key)).alias("dedup_key"), F.lit("aws_cloudtrail").alias("source"),
            F.struct(
                F.col("region").alias("region"), F.col("account").alias("account"),
                F.when(foreign, "999999999999").otherwise(F.col("account")).alias("caller_account"),
                F.when(foreign, "AWSAccount").when(root, "Root").when(cust % 5 == 0, "AssumedRole")
                .otherwise("IAMUser").alias("principal_type"),
                F.concat(F.when(cust % 4 == 0, "AKIA").otherwise("ASIA"), text(cust)).alias("access_key_id"),
                F.concat(F.lit("agent/"), text(cust % 6)).alias("user_agent"),
                F.when(st == "F", "AccessDenied").when(st == "P", "Throttling").alias("error_code"),
                F.when(cust % 2 == 0, "No").otherwise("Yes").alias("mfa"),
                F.array(F.concat(F.lit("res"), text(key % 60)), F.concat(F.lit("a/b"), text(cust % 9))).alias("targets"),
                (cust % 3 == 0).alias("from_console"), zone.alias("request"),
            ).alias("_raw"),
        )
        return conform_events(_wrap_raw(rows))

    @cached_property
    def gd(self) -> DataFrame:
        start = F.lit("2024-01-01 00:00:00").cast("timestamp")
        size = F.col("p_size")
        rows = self.raw("part").select(
            F.col("p_partkey").alias("id"), F.timestamp_add("MINUTE", "p_partkey", start).alias("ts"),
            F.col("p_type").alias("program"),
            F.when(size >= 45, "CRITICAL").when(size >= 35, "HIGH").when(size >= 20, "MEDIUM").otherwise("LOW").alias("severity"),
            F.col("p_name").alias("message"), F.concat(F.lit("acct"), (size % 4).cast("string")).alias("user"),
            F.lit("100000000001/us-east-1").alias("device"),
            F.concat(F.lit("gd:"), F.col("p_partkey").cast("string")).alias("dedup_key"),
            F.lit("ids").alias("kind"), F.lit("aws_guardduty").alias("source"),
            F.struct(
                (size / 5.0).alias("score"), F.col("p_brand").endswith("1").alias("sample"),
                F.when(size % 3 == 0, F.concat(F.lit("i-"), (size % 10).cast("string"))).alias("instance_id"),
                F.lit("Instance").alias("resource_type"), F.concat(F.lit("about "), "p_name").alias("description"),
            ).alias("_raw"),
        )
        return conform_events(_wrap_raw(rows))

    @cached_property
    def events(self) -> DataFrame:
        """Every view as one event table."""
        out = self.fw
        for view in (self.dns, self.ssh, self.win, self.web, self.wifi, self.ids, self.cloud, self.gd):
            out = out.unionByName(view)
        return out


    # ----- earlier runs

    def baseline(self, history: DataFrame, as_of: str, prior: DataFrame | None = None) -> Baseline:
        """A baseline that knows the entities of ``history`` and, by default, one prior metric."""
        known = H.entities(H.observations(history, "earlier", "1990-01-01 00:00:00"))
        if prior is None:
            prior = history.agg(F.count("*").cast("double").alias("prior")).select(
                F.lit("events").alias("key"), "prior"
            )
        return Baseline(
            as_of=as_of, known=known, prior=prior, findings=self.findings, metrics=self.metrics,
            watchlist=self.watchlist,
        )

    @cached_property
    def findings(self) -> DataFrame:
        """Findings of earlier runs, from the orders table."""
        cust, key = F.col("o_custkey"), F.col("o_orderkey")
        text = lambda c: c.cast("string")
        outside = F.concat(F.lit("198.51."), text((cust % 100 + 1) % 3 + 100), F.lit("."), text((cust % 100 + 1) % 250 + 1))
        inside = F.concat(F.lit("10.10.0."), text(cust % 50 + 20))
        ent = lambda t, v, r: F.struct(F.lit(t).alias("type"), v.alias("value"), F.lit(r).alias("role"))
        rows = self.raw("orders").select(
            F.concat(F.lit("run"), text(key % 20)).alias("run_id"), F.concat(F.lit("F"), text(key)).alias("finding_id"),
            F.col("o_orderdate").cast("timestamp").alias("ts"), F.concat(F.lit("About "), "o_orderpriority").alias("title"),
            (cust % 5).cast("int").alias("severity"), F.lit("medium").alias("confidence"),
            _pick(("scan.persistent_prober", "c2.beacon_candidate", "recon.internal_traceroute", "dns.tunnel_suspect"), cust % 4).alias("taxonomy"),
            F.array(ent("ip", outside, "source"), ent("ip", inside, "destination")).alias("entities"),
        )
        return conform(rows, FINDING_SCHEMA)

    @cached_property
    def metrics(self) -> DataFrame:
        """Metrics of earlier runs (``run_id, ts, key, value_num, value_text``), from the orders table."""
        cust, key = F.col("o_custkey"), F.col("o_orderkey")
        text = lambda c: c.cast("string")
        name = _pick(
            ("zone.lan.daypart.night", "zone.iot.daypart.morning", "zone.iot.daypart.evening", "zone.lan.daypart.afternoon", "fw.drops"),
            cust % 5,
        )
        return self.raw("orders").select(
            F.concat(F.lit("run"), text(key % 20)).alias("run_id"), F.col("o_orderdate").cast("timestamp").alias("ts"),
            name.alias("key"), F.when(cust % 5 != 4, (key % 8).cast("double")).when(key % 3 > 0, F.col("o_totalprice")).alias("value_num"),
            F.when((cust % 5 == 4) & (key % 3 == 0), F.lit("n/a")).alias("value_text"),
        )

    @cached_property
    def watchlist(self) -> DataFrame:
        """Watched entities, from the supplier table."""
        s = F.col("s_suppkey")
        text = lambda c: c.cast("string")
        kind = _pick(("ip", "host", "domain", "host"), s % 4)
        value = (
            F.when(s % 4 == 2, "the.example.com").when(s % 8 == 3, text(s % 5 + 1))
            .otherwise(F.concat(F.lit("10.10."), F.when(s % 8 < 4, "0.").otherwise("50."), text(s % 60 + 1)))
        )
        return self.raw("supplier").select(
            kind.alias("entity_type"), value.alias("entity_value"), F.col("s_name").alias("reason"),
            F.lit("1998-01-01 00:00:00").cast("timestamp").alias("created_at"),
            F.when(s % 3 > 0, F.timestamp_add("DAY", s.cast("int"), F.lit("1998-05-01 00:00:00").cast("timestamp"))).alias("expires_at"),
        )

    @cached_property
    def indicators(self) -> DataFrame:
        """Indicator lists from the supplier, nation and page tables."""
        s, n = F.col("s_suppkey"), F.col("n_nationkey")
        text = lambda c: c.cast("string")
        tiers = ("T1", "T2", "T3", "T4")
        sev = lambda i: (F.lit(4) - i % 4).cast("int")
        more = {"campaign": F.lit("c"), "warning": F.lit(""), "expires": F.lit(None).cast("date"), "origin": F.lit("list.csv")}
        single = self.raw("supplier").select(
            F.concat(F.lit("203.0.113."), text(s)).alias("value"), F.lit("ip").alias("kind"), sev(s).alias("severity"),
            _pick(tiers, s % 4).alias("tier"), F.col("s_name").alias("source"),
        )
        nets = self.raw("nation").select(
            F.when(n % 3 == 0, F.concat(F.lit("198.51.100."), text(n * 8), F.lit("/29")))
            .when(n % 3 == 1, F.concat(F.lit("203.0.113."), text(n * 8), F.lit("/30")))
            .otherwise(F.concat(F.lit("198."), text(n + 30), F.lit(".0.0/15"))).alias("value"),
            F.lit("cidr").alias("kind"), sev(n).alias("severity"), _pick(tiers, n % 4).alias("tier"), F.col("n_name").alias("source"),
        )
        host = F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
        names = (
            self.raw("pages").groupBy(host.alias("host")).agg(F.min("page_id").alias("p"))
            .select(
                F.when(F.col("p") % 2 == 0, F.col("host")).otherwise(F.substring_index("host", ".", -2)).alias("value"),
                F.when(F.col("p") % 2 == 0, "domain").otherwise("domain_suffix").alias("kind"), F.col("p"),
            )
            .groupBy("value", "kind").agg(F.min("p").alias("p"))
            .select("value", "kind", sev(F.col("p")).alias("severity"), _pick(tiers, F.col("p") % 4).alias("tier"), F.lit("pages").alias("source"))
        )
        return single.unionByName(nets).unionByName(names).withColumns(more)


def _wrap_raw(rows: DataFrame) -> DataFrame:
    """Widen a partial ``_raw`` struct to the full payload type."""
    from sentrylake.schema import RAW_SCHEMA

    have = set(rows.schema["_raw"].dataType.names)
    fields = [
        (F.col(f"_raw.{f.name}") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in RAW_SCHEMA.fields
    ]
    return rows.withColumn("raw", F.struct(*fields)).drop("_raw")
