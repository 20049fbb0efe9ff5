"""Registered queries: sources and normalisers, sinks, ad-hoc SQL and streams.

Raw log lines, resolver queries, audit records and lists are spelled out from the given tables, so
the SQL side can state what each must become without parsing anything.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.functions import domains, scalars
from sentrylake.operators import history as H
from sentrylake.operators import query as q
from sentrylake.operators.perimeter import stepped_ttl
from sentrylake.plans.registry import query
from sentrylake.plans.tables import AS_OF, zone_sql
from sentrylake.session import materialize, scratch_path
from sentrylake.sources import cloudtrail, common, devices, dnslog, guardduty, lists, sinks, syslog
from sentrylake.sources.runstore import RunStore
from sentrylake.sources.window import Window
from sentrylake.streaming import jobs
from sentrylake.streaming.batches import BatchTable


def _s(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _cat(*parts) -> Column:
    return F.concat(*[_s(p) if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def _pick(values, i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))


# ----- syslog

_WIN = (
    "An account {what}.    Subject:  \\011Security ID:\\011\\011S-1-5-18  \\011Account Name:\\011\\011HOST$  \\011Account Domain:\\011\\011WG    "
    "Logon Information:  \\011Logon Type:\\011\\011{type}    {section}  \\011Security ID:\\011\\011S-1-5-21  \\011Account Name:\\011\\011"
)
_WIN_TAIL = "  \\011Account Domain:\\011\\011WG    Network Information:  \\011Source Network Address:\\011"


def lines_of(t) -> DataFrame:
    """Landed syslog lines of every supported sort, one per order."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    mac = F.lpad(F.lower(F.hex(c % 256)), 2, "0")
    kind = k % 12
    proto = _pick(("6", "17", "TCP", "89"), c % 4)
    fields = _cat("IN=eth", c % 3, " OUT= MAC=aa:bb SRC=203.0.113.", c % 200, " DST=10.10.0.", k % 200, " LEN=", k % 1500, " TTL=", k % 64,
                  " PROTO=", proto, " SPT=", c % 1000 + 40000, " DPT=", k % 1024)
    win_ok = _cat(_WIN.format(what="was successfully logged on", type="10", section="New Logon:"), "win", c % 33, _WIN_TAIL,
                  F.when(c % 2 == 0, "-").otherwise(_cat("203.0.113.", c % 50)), "  \\011Source Port:\\0115")
    win_bad = _cat(_WIN.format(what="failed to log on", type="3", section="Account For Which Logon Failed:"), "win", c % 33, _WIN_TAIL, "10.10.15.7")
    ssh = (
        F.when(c % 5 == 0, _cat("Accepted publickey for acct", c % 40, " from 203.0.113.9 port ", k % 60000, " ssh2"))
        .when(c % 5 == 1, _cat("Failed password for invalid user acct", c % 40, " from 10.10.0.9 port ", k % 60000, " ssh2"))
        .when(c % 5 == 2, _cat("Invalid user acct", c % 40, " from 10.10.0.9"))
        .when(c % 5 == 3, _cat("pam_unix(sshd:session): session opened for user acct", c % 40, "(uid=0)"))
        .otherwise("Connection closed")
    )
    bear = (
        F.when(c % 4 == 0, _cat("Password auth succeeded for 'acct", c % 40, "' from 10.10.0.9:", k % 60000))
        .when(c % 4 == 1, _cat("Bad password attempt for 'acct", c % 40, "' from 10.10.0.9:", k % 60000))
        .when(c % 4 == 2, _cat("Exit before auth from <10.10.0.9:", k % 60000, ">: Max auth tries reached - user 'is invalid'"))
        .otherwise(_cat("Exit before auth from <10.10.0.9:", k % 60000, ">: Exited normally"))
    )
    msg = (
        F.when(kind == 0, _cat("DROP ", fields))
        .when(kind == 1, _cat("[4081.5] reject wan out: SRC=1.1.1.1 ", fields))
        .when(kind == 2, "daemon up")
        .when(kind == 3, _cat("eth7: STA 02:AB:CD:00:00:", mac, " IEEE 802.11: Deauthenticated"))
        .when(kind == 4, F.when(c % 3 == 0, _cat("DHCPDISCOVER(br0) 02:AB:CD:00:00:", mac)).otherwise(_cat("DHCPACK(br0) 10.10.50.", c % 200, " 02:AB:CD:00:00:", mac, " host", c)))
        .when(kind == 5, _cat(k, " ", F.when(c % 5 == 0, "127.0.0.1").otherwise(_cat("10.10.50.", c % 200)), "/5353 query[AAAA] name", c % 90, ".example.com from 10.10.50.1"))
        .when(kind == 6, _cat("[info] luci: ", F.when(c % 2 == 0, "accepted").otherwise("failed"), " login on /admin for root from 10.10.0.", c % 60))
        .when(kind == 7, _cat("[LOGIN][http][Web] successed (198.51.100.", c % 60, ")"))
        .when(kind == 8, F.when(c % 3 == 0, win_bad).otherwise(win_ok))
        .when(kind == 9, ssh)
        .when(kind == 10, bear)
        .otherwise("job done")
    )
    program = _pick(("kernel", "KERNEL", "VPNSERVER1", "hostapd", "DNSMASQ-DHCP", "dnsmasq", "UHTTPD", "HTTPD", "Microsoft-Windows-Security-Audit",
                     "SSHD-SESSION", "dropbear", "CRON"), kind)
    ts = F.col("o_orderdate").cast("timestamp")
    stamp = (
        F.when(k % 50 == 7, "n/a").when(k % 4 == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(k % 4 == 1, F.concat(F.date_format(ts, "yyyy-MM-dd"), F.lit("T"), F.date_format(ts, "HH:mm:ss"), F.lit(".125Z")))
        .when(k % 4 == 2, _s(F.unix_seconds(ts))).otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm"))
    )
    lines = t.raw("orders").select(
        _s(c % 7).alias("device"), stamp.alias("timestamp"), program.alias("program"), msg.alias("msg"), _s(k).alias("seq"), _s(k % 10).alias("level")
    )
    return materialize(lines, "lines")


# What each line must become.
PARSED = """parsed AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 12 AS s, o_orderdate AS ts, CAST(o_custkey % 7 AS VARCHAR) AS device,
  '02:ab:cd:00:00:' || lpad(lower(to_hex(o_custkey % 256)), 2, '0') AS mac FROM orders WHERE o_orderkey % 50 <> 7),
lined AS (SELECT k, device, ts, ['emerg','alert','crit','err','warning','notice','info','debug','8','9'][k % 10 + 1] AS severity,
  ['KERNEL','KERNEL','VPNSERVER1','HOSTAPD','DNSMASQ-DHCP','DNSMASQ','UHTTPD','HTTPD','MICROSOFT-WINDOWS-SECURITY-AUDIT','SSHD-SESSION','DROPBEAR','CRON'][s + 1] AS program,
  CASE WHEN s < 2 THEN 'firewall' WHEN s IN (2, 3, 6, 7, 8) THEN 'auth' WHEN s = 5 AND c % 5 <> 0 THEN 'dns' WHEN s = 9 AND c % 5 < 4 THEN 'auth' WHEN s = 10 AND c % 4 < 3 THEN 'auth' ELSE 'system' END AS kind,
  CASE s WHEN 0 THEN 'drop' WHEN 1 THEN 'reject' WHEN 3 THEN 'deauth' WHEN 4 THEN (CASE WHEN c % 3 = 0 THEN 'dhcpdiscover' ELSE 'dhcpack' END)
    WHEN 6 THEN (CASE WHEN c % 2 = 0 THEN 'web_login_success' ELSE 'web_login_failed' END) WHEN 7 THEN 'web_login_success' WHEN 8 THEN (CASE WHEN c % 3 = 0 THEN 'logon_failed' ELSE 'logon_success' END)
    WHEN 9 THEN ['ssh_accepted', 'ssh_failed', 'ssh_invalid', 'session_open', NULL][c % 5 + 1] WHEN 10 THEN ['ssh_accepted', 'ssh_failed', 'ssh_invalid', NULL][c % 4 + 1] END AS action,
  CASE WHEN s < 2 THEN ['tcp', 'udp', 'tcp', 'ospf'][c % 4 + 1] WHEN s = 8 THEN (CASE WHEN c % 3 = 0 THEN 'network' ELSE 'rdp' END) WHEN s = 9 AND c % 5 = 0 THEN 'publickey' WHEN s = 9 AND c % 5 = 1 THEN 'password' END AS proto,
  CASE WHEN s < 2 THEN 'eth' || (c % 3) END AS iface_in, CASE WHEN s < 2 THEN '203.0.113.' || (c % 200) WHEN s = 4 AND c % 3 > 0 THEN '10.10.50.' || (c % 200) WHEN s = 6 THEN '10.10.0.' || (c % 60)
    WHEN s = 7 THEN '198.51.100.' || (c % 60) WHEN s = 8 AND c % 3 = 0 THEN '10.10.15.7' WHEN s = 8 AND c % 2 = 1 THEN '203.0.113.' || (c % 50)
    WHEN s = 9 AND c % 5 = 0 THEN '203.0.113.9' WHEN s = 9 AND c % 5 IN (1, 2) THEN '10.10.0.9' WHEN s = 10 AND c % 4 < 3 THEN '10.10.0.9' END AS src_ip,
  CASE WHEN s < 2 THEN c % 1000 + 40000 WHEN s = 9 AND c % 5 < 2 THEN k % 60000 WHEN s = 10 AND c % 4 < 3 THEN k % 60000 END AS src_port,
  CASE WHEN s < 2 THEN '10.10.0.' || (k % 200) END AS dst_ip, CASE WHEN s < 2 THEN k % 1024 END AS dst_port, CASE WHEN s < 2 THEN k % 64 END AS ttl, CASE WHEN s < 2 THEN k % 1500 END AS pkt_len,
  CASE WHEN s IN (3, 4) THEN mac WHEN s = 6 THEN 'root' WHEN s = 8 THEN 'win' || (c % 33) WHEN s = 9 AND c % 5 < 4 THEN 'acct' || (c % 40) WHEN s = 10 AND c % 4 < 2 THEN 'acct' || (c % 40) END AS "user",
  CASE WHEN s = 5 AND c % 5 <> 0 THEN '10.10.50.' || (c % 200) END AS client_ip, CASE WHEN s = 5 AND c % 5 <> 0 THEN 'name' || (c % 90) || '.example.com' END AS domain,
  CASE WHEN s = 5 AND c % 5 <> 0 THEN 'AAAA' END AS qtype FROM parsed)"""

_MINUTE = "CASE WHEN k % 4 = 3 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END"


def _parsed(t) -> DataFrame:
    return syslog.parse_lines(lines_of(t).withColumn("program", F.upper("program")))


def _events(t) -> DataFrame:
    return syslog.normalize_syslog(lines_of(t), t.profile)


_COLS = ["ts", "device", "program", "severity", "kind", "action", "proto", "iface_in", "src_ip", "src_port", "dst_ip", "dst_port", "ttl", "pkt_len", "user",
         "client_ip", "domain", "qtype", "src_zone", "dst_zone"]


@query("s02_normalize_syslog", "", f"""WITH {PARSED} SELECT {_MINUTE} AS ts, device, program, severity, kind, action, proto, iface_in, src_ip, src_port, dst_ip, dst_port, ttl, pkt_len, "user", client_ip, domain, qtype,
  {zone_sql('coalesce(src_ip, client_ip)')} AS src_zone, {zone_sql('dst_ip')} AS dst_zone FROM lined""")
def _(t):
    """Every parser at once (s02, s07, s09, s12, s13, s26)."""
    return _events(t).select(*_COLS)


@query("s03_parse_firewall_line", "fw", """SELECT id, action, proto, iface_in, src_ip, src_port::BIGINT AS src_port, dst_ip, dst_port::BIGINT AS dst_port, ttl::BIGINT AS ttl, pkt_len::BIGINT AS pkt_len FROM fw""")
def _(t):
    line = _cat("[1.5] ", F.col("action"), " in: IN=", F.col("iface_in"), " SRC=9.9.9.9 SRC=", F.col("src_ip"), " DST=", F.col("dst_ip"), " LEN=", F.col("pkt_len"),
                " TTL=", F.col("ttl"), " PROTO=", F.when(F.col("proto") == "tcp", "6").otherwise("UDP"), " SPT=", F.col("src_port"), " DPT=", F.col("dst_port"))
    lines = materialize(t.fw.select("id", F.lit("KERNEL").alias("program"), line.alias("msg")), "firewall-lines")
    return syslog.parse_lines(lines).select("id", "action", "proto", "iface_in", "src_ip", "src_port", "dst_ip", "dst_port", "ttl", "pkt_len")


_SENTENCES = (*(sentence for sentence, _, _ in syslog.WINDOWS_EVENTS), syslog.DEFENDER_PREFIX, "Scan finished")


@query("s09_parse_endpoint_lines", "", """WITH p AS (SELECT o_orderkey AS k, o_orderkey % 7 AS s, o_orderkey % 5 = 0 AS other FROM orders)
SELECT k, CASE WHEN s = 5 AND NOT other THEN 'ids' WHEN s < 5 AND NOT other THEN 'auth' ELSE 'system' END AS kind,
  CASE WHEN NOT other THEN ['logon_success', 'logon_failed', 'privileged', 'explicit_creds', 'lockout', 'detection', NULL][s + 1] END AS action,
  CASE WHEN s < 5 AND NOT other THEN 'win' || (k % 33) END AS "user" FROM p""")
def _(t):
    """Every sentence of logons and of endpoint protection, a fifth of them from programs that they don't count for."""
    k = F.col("o_orderkey")
    s, other = k % 7, k % 5 == 0
    section = _pick(("New Logon:", "Account For Which Logon Failed:", "Subject:", "Account Whose Credentials Were Used:", "Account That Was Locked Out:", "", ""), s)
    msg = _cat(_pick(_SENTENCES, s), ".    ", section, "  \\011Security ID:\\011\\011S-1-5-21  \\011Account Name:\\011\\011win", k % 33, "  \\011Account Domain:\\011\\011WG")
    program = F.when(other, "CRON").when(s < 5, "MICROSOFT-WINDOWS-SECURITY-AUDIT").otherwise("MICROSOFT-WINDOWS-WINDOWS_DEFENDER")
    lines = materialize(t.raw("orders").select(k.alias("k"), program.alias("program"), msg.alias("msg")), "endpoint-lines")
    return syslog.parse_lines(lines).select("k", "kind", "action", "user")


@query("s04_normalize_protocol", "", """SELECT p_partkey, coalesce(['icmp', 'igmp', 'tcp', 'udp', 'gre', 'esp', 'icmpv6', 'ospf', 'tcp', '99', NULL][p_partkey % 11 + 1], NULL) AS proto FROM part""")
def _(t):
    raw = _pick(("1", "2", "6", "17", "47", "50", "58", "89", "TCP", "99", ""), F.col("p_partkey") % 11)
    return t.raw("part").select("p_partkey", scalars.normalize_protocol(raw).alias("proto"))


@query("s05_parse_dhcp_lease", "", f"""WITH {PARSED} SELECT k::VARCHAR AS seq, CASE WHEN c % 3 = 0 THEN 'DHCPDISCOVER' ELSE 'DHCPACK' END AS verb, CASE WHEN c % 3 > 0 THEN '10.10.50.' || (c % 200) END AS ip, mac, CASE WHEN c % 3 > 0 THEN 'host' || c END AS hostname
  FROM (SELECT o_orderkey AS k, o_custkey AS c, '02:ab:cd:00:00:' || lpad(lower(to_hex(o_custkey % 256)), 2, '0') AS mac FROM orders) WHERE k % 12 = 4""")
def _(t):
    lease = syslog.dhcp_lease(F.col("msg"))
    return lines_of(t).where(F.col("program") == "DNSMASQ-DHCP").select("seq", *[c.alias(n) for n, c in lease.items()])


@query("s06_parse_dnsmasq_query", "", """SELECT o_orderkey::VARCHAR AS seq, '10.10.50.' || (o_custkey % 200) AS client_ip, 'AAAA' AS qtype, 'name' || (o_custkey % 90) || '.example.com' AS domain, false AS blocked
  FROM orders WHERE o_orderkey % 12 = 5 AND o_custkey % 5 <> 0""")
def _(t):
    return _parsed(t).where("kind = 'dns'").select("seq", "client_ip", "qtype", "domain", "blocked")


@query("s08_parse_windows_logon", "", """SELECT o_orderkey::VARCHAR AS seq, CASE WHEN o_custkey % 3 = 0 THEN 'logon_failed' ELSE 'logon_success' END AS action, 'win' || (o_custkey % 33) AS "user",
  CASE WHEN o_custkey % 3 = 0 THEN 'network' ELSE 'rdp' END AS proto, CASE WHEN o_custkey % 3 = 0 THEN '10.10.15.7' WHEN o_custkey % 2 = 1 THEN '203.0.113.' || (o_custkey % 50) END AS src_ip FROM orders WHERE o_orderkey % 12 = 8""")
def _(t):
    return _parsed(t).where("program like 'MICROSOFT%' and kind = 'auth'").select("seq", "action", "user", "proto", "src_ip")


@query("s10_parse_openssh", "", """SELECT o_orderkey::VARCHAR AS seq, ['ssh_accepted', 'ssh_failed', 'ssh_invalid', 'session_open'][o_custkey % 5 + 1] AS action, 'acct' || (o_custkey % 40) AS "user",
  CASE WHEN o_custkey % 5 < 2 THEN o_orderkey % 60000 END AS src_port FROM orders WHERE o_orderkey % 12 = 9 AND o_custkey % 5 < 4""")
def _(t):
    return _parsed(t).where("program like 'SSHD%' and kind = 'auth'").select("seq", "action", "user", "src_port")


@query("s11_parse_dropbear", "", """SELECT o_orderkey::VARCHAR AS seq, ['ssh_accepted', 'ssh_failed', 'ssh_invalid'][o_custkey % 4 + 1] AS action, CASE WHEN o_custkey % 4 < 2 THEN 'acct' || (o_custkey % 40) END AS "user",
  '10.10.0.9' AS src_ip, o_orderkey % 60000 AS src_port FROM orders WHERE o_orderkey % 12 = 10 AND o_custkey % 4 < 3""")
def _(t):
    return _parsed(t).where("program = 'DROPBEAR' and kind = 'auth'").select("seq", "action", "user", "src_ip", "src_port")


@query("s13_parse_timestamp", "", """SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 7 THEN NULL WHEN o_orderkey % 4 = 3 THEN date_trunc('minute', o_orderdate) ELSE date_trunc('second', o_orderdate) END AS ts,
  ['emerg','alert','crit','err','warning','notice','info','debug','8','9'][o_orderkey % 10 + 1] AS severity FROM orders""")
def _(t):
    return lines_of(t).select(
        F.col("seq").cast("bigint").alias("o_orderkey"), syslog.parse_timestamp(F.col("timestamp")).alias("ts"), scalars.syslog_severity("level").alias("severity")
    )


@query("s01_load_syslog", "", f"""WITH {PARSED} SELECT device, kind, action, count(*) AS n FROM lined GROUP BY device, kind, action""")
def _(t):
    """Pages written as they land, read back, parsed and made distinct; every page is landed twice."""
    lines = lines_of(t)
    entry = F.struct("timestamp", "program", "msg", F.col("seq").cast("bigint").alias("seq"), F.col("level").cast("int").alias("level"))
    pages = (
        lines.withColumn("page", F.floor(F.col("seq").cast("bigint") / 2000))
        .groupBy("device", "page")
        .agg(F.count("*").alias("total"), F.collect_list(entry).alias("logs"))
        .withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    )
    path = scratch_path(t.spark, "syslog-landing")
    # One page per file, below its device: folders don't grow with the pages.
    pages.repartition("device", "page", "copy").drop("page", "copy").write.partitionBy("device").option("maxRecordsPerFile", 1).json(path)
    return syslog.load_syslog(t.spark, path, t.profile).groupBy("device", "kind", "action").agg(F.count("*").alias("n"))


# ----- resolver log


def _queries(t) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    name = _cat("Host", u, F.lit("."), "Example.COM", F.when(e % 3 == 0, ".").otherwise(""))
    name = F.when(e % 17 == 0, F.concat(name, F.lit("\x01​"))).otherwise(name)
    rows = t.raw("events").select(
        e.alias("id"), F.when(e % 40 == 1, "soon").when(e % 40 == 2, None).otherwise(_s(F.unix_seconds(F.col("ts").cast("timestamp")))).alias("time"), name.alias("domain"),
        F.when(e % 2 == 0, "A").alias("type"), _pick(("gravity", "FORWARDED", "IN_PROGRESS", "REGEX", "CACHE"), e % 5).alias("status"),
        F.when(e % 3 == 0, _cat('{"ip":"10.10.0.', u % 100, '","name":"x"}')).when(e % 3 == 1, _cat('{"ip":null,"name":"10.10.50.', u % 100, '"}')).otherwise(_cat("10.10.15.", u % 100)).alias("client"),
        F.when(e % 4 == 0, '{"ip":"9.9.9.9","name":"dns9"}').when(e % 4 == 1, "1.1.1.1").alias("upstream"), F.lit(2).alias("pos"),
    )
    stale = rows.withColumns({"status": F.lit("OLD"), "pos": F.lit(1)})
    return rows.unionByName(stale).withColumn("file", F.lit("page1"))


@query("s14_normalize_dns_queries", "", f"""SELECT 'resolver:' || substr(sha1('resolver|' || event_id), 1, 20) AS dedup_key, date_trunc('second', ts) AS ts, 'host' || user_id || '.example.com' AS domain, CASE WHEN event_id % 2 = 0 THEN 'A' END AS qtype,
  event_id % 5 IN (0, 3) AS blocked, ['GRAVITY', 'FORWARDED', '', 'REGEX', 'CACHE'][event_id % 5 + 1] AS block_reason, client_ip, CASE event_id % 4 WHEN 0 THEN 'dns9' WHEN 1 THEN '1.1.1.1' END AS upstream, {zone_sql('client_ip')} AS src_zone
  FROM (SELECT *, ['10.10.0.', '10.10.50.', '10.10.15.'][event_id % 3 + 1] || (user_id % 100) AS client_ip FROM events) WHERE event_id % 40 NOT IN (1, 2) AND event_id % 5 <> 2""")
def _(t):
    done = dnslog.normalize_dns_queries(_queries(t), t.profile)
    return done.select("dedup_key", "ts", "domain", "qtype", "blocked", "block_reason", "client_ip", "upstream", "src_zone")


@query("s15_blocked_status_set", "", """SELECT status, status IN ('GRAVITY', 'REGEX') AS blocked, count(*) AS n FROM (SELECT ['GRAVITY', 'FORWARDED', 'IN_PROGRESS', 'REGEX', 'CACHE'][event_id % 5 + 1] AS status FROM events) GROUP BY 1, 2""")
def _(t):
    status = F.upper("status")
    rows = _queries(t).where(F.col("pos") == 2).select(status.alias("status"), status.isin(*dnslog.BLOCKED_STATUSES).alias("blocked"))
    return rows.groupBy("status", "blocked").agg(F.count("*").alias("n"))


@query("s16_clean_domain", "", """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE 'host' || user_id || '.example.com' END AS domain FROM events""")
def _(t):
    e = F.col("event_id")
    raw = F.when(e % 10 == 0, " \x02. ").otherwise(
        F.concat(F.lit(" Ho\x00st"), _s("user_id"), F.lit(".Exa�mple.COM"), F.when(e % 3 == 0, F.lit("..")).otherwise(F.lit("  ")))
    )
    return t.raw("events").select("event_id", domains.clean_domain(raw).alias("domain"))


# ----- cloud audit and findings


def _records(t) -> DataFrame:
    k, c, st = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    request = (
        F.when(k % 6 == 0, _cat('{"bucketName":"b', c % 60, '","name":["n1",7,"n', c % 9, '"],"zeta":"z"}'))
        .when(k % 6 == 1, _cat('{"instancesSet":{"items":[{"instanceId":"i-', c % 20, '"},{"x":1}]},"name":5}'))
        .when(k % 6 == 2, _cat('{"note":"', F.repeat(F.lit("x"), 2100), '"}')).when(k % 6 == 3, "{}")
    )
    login = k % 10 == 0
    text = lambda v: F.lit(v).cast("string")
    return t.raw("orders").select(
        F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("eventTime"),
        F.when(login, "signin.amazonaws.com").otherwise("s3.amazonaws.com").alias("eventSource"), F.when(login, "ConsoleLogin").otherwise("PutObject").alias("eventName"),
        F.lit("us-east-1").alias("awsRegion"), F.when(c % 5 == 0, "AWS Internal").otherwise(_cat("203.0.113.", c % 50)).alias("sourceIPAddress"), text("agent").alias("userAgent"),
        F.when(st == "F", "Client.UnauthorizedOperation").when((st == "P") & ~login, "Throttling").alias("errorCode"), text(None).alias("errorMessage"), _cat("ev", F.floor(k / 2)).alias("eventID"),
        text("AwsApiCall").alias("eventType"), F.when(k % 3 > 0, k % 3 == 1).alias("readOnly"), F.when(c % 2 == 0, "111111111111").alias("recipientAccountId"), request.alias("requestParameters"),
        F.when(c % 4 == 0, "true").alias("sessionCredentialFromConsole"), F.struct(F.when(login, F.when(st == "O", "Success").otherwise("Failure")).alias("ConsoleLogin")).alias("responseElements"),
        F.struct(F.when(login, F.when(c % 2 == 0, "Yes").otherwise("No")).alias("MFAUsed")).alias("additionalEventData"),
        F.struct(
            _pick(("IAMUser", "AssumedRole", "Root", "AWSService", "Unknown"), c % 5).alias("type"), _cat("AID", c % 30).alias("principalId"),
            F.when(c % 5 < 3, _cat("arn:aws:iam::222222222222:user/u", c % 30)).alias("arn"), F.lit("222222222222").alias("accountId"), _cat("AKIA", c % 30).alias("accessKeyId"),
            F.struct(F.struct(F.when(c % 2 == 0, _cat("arn:aws:iam::222222222222:role/r", c % 9)).alias("arn")).alias("sessionIssuer"), F.struct(F.lit("false").alias("mfaAuthenticated")).alias("attributes")).alias("sessionContext"),
        ).alias("userIdentity"),
        F.lit("f").alias("file"), k.alias("pos"),
    )


_RECORDS = """rec AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, date_trunc('second', o_orderdate) AS ts, o_orderkey % 10 = 0 AS login, CASE WHEN o_custkey % 2 = 0 THEN '111111111111' ELSE '222222222222' END AS acct FROM orders WHERE o_custkey % 5 <> 3),
firsts AS (SELECT *, row_number() OVER (PARTITION BY k // 2 ORDER BY k) AS r FROM rec),
ct AS (SELECT *, CASE c % 5 WHEN 2 THEN 'arn:aws:iam::' || acct || ':root' WHEN 1 THEN (CASE WHEN c % 2 = 0 THEN 'arn:aws:iam::222222222222:role/r' || (c % 9) ELSE 'arn:aws:iam::222222222222:user/u' || (c % 30) END)
    WHEN 0 THEN 'arn:aws:iam::222222222222:user/u' || (c % 30) ELSE 'Unknown:AID' || (c % 30) END AS principal FROM firsts WHERE r = 1)"""


def _audit_folders(t) -> str:
    """The audit records of the orders as delivered files: of two accounts, two regions, 60 days and 6 hours each."""
    k = F.col("pos")
    start = F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + (k % 60) * 86400 + k % 86400
    at = F.timestamp_seconds(start)
    rows = _records(t).withColumns(
        {"eventTime": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), "awsRegion": _pick(("us-east-1", "eu-west-1"), k % 2), "eventID": _cat("ev", k)}
    )
    account, region = _pick(("111111111111", "o-x1/222222222222"), k % 3 % 2), F.col("awsRegion")
    delivered = F.timestamp_add("MINUTE", F.lit(15), F.timestamp_seconds((F.floor(start / 21600) + 1) * 21600))
    path = F.concat_ws("/", F.lit("AWSLogs"), account, F.lit("CloudTrail"), region, F.date_format(at, "yyyy/MM/dd"),
                       F.concat(F.lit("a_CloudTrail_b_"), F.date_format(F.least(delivered, F.date_trunc("day", at) + F.expr("INTERVAL '23:59:00' HOUR TO SECOND")), "yyyyMMdd'T'HHmm"), F.lit("Z_x.json.gz")))
    record = F.to_json(F.struct(*[c for c in rows.columns if c not in ("file", "pos")]))
    files = rows.groupBy(path.alias("path")).agg(_cat('{"Records":[', F.array_join(F.sort_array(F.collect_list(record)), ","), "]}").alias("body"))
    root = scratch_path(t.spark, "audit")

    def write(batches):
        import gzip

        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = fs.FileSystem.from_uri(f"{root}/{name}" if "://" in root else "file://" + f"{root}/{name}".removeprefix("file:"))
                store.create_dir(at.rsplit("/", 1)[0])
                with store.open_output_stream(at, compression=None) as f:
                    f.write(gzip.compress(body.encode()))
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["path"])

    materialize(files.mapInArrow(write, "path string"), "audit-paths")
    return root


@query("s17_scan_cloudtrail", "", """WITH e AS (SELECT o_orderkey AS k, TIMESTAMP '2024-01-01 00:00:00' + (o_orderkey % 60) * INTERVAL 1 DAY + (o_orderkey % 86400) * INTERVAL 1 SECOND AS ts FROM orders)
  SELECT 'ev' || k AS event_id, ts, CASE k % 2 WHEN 0 THEN 'us-east-1' ELSE 'eu-west-1' END AS region FROM e WHERE ts >= TIMESTAMP '2024-01-20 05:00:00' AND ts < TIMESTAMP '2024-02-03 17:30:00' AND k % 3 % 2 = 1""")
def _(t):
    """Two weeks of one account, read from folders of 60 days."""
    window = Window(datetime(2024, 1, 20, 5, tzinfo=timezone.utc), datetime(2024, 2, 3, 17, 30, tzinfo=timezone.utc))
    records = cloudtrail.scan_cloudtrail(t.spark, _audit_folders(t), window, accounts=["222222222222"])
    rows = records.select(F.col("eventID").alias("event_id"), F.col("eventTime").cast("timestamp").alias("ts"), F.col("awsRegion").alias("region"))
    return rows.where(window.contains_half_open("ts"))


@query("s18_normalize_cloudtrail", "", f"""WITH {_RECORDS} SELECT 'aws_cloudtrail:' || substr(sha1('aws_cloudtrail|ev' || (k // 2)), 1, 20) AS dedup_key, ts, CASE WHEN login THEN 'auth' ELSE 'other' END AS kind,
  CASE WHEN login THEN (CASE WHEN st = 'O' THEN 'aws_login_ok' ELSE 'aws_login_fail' END) WHEN st = 'O' THEN 'ok' WHEN st = 'F' THEN 'denied' ELSE 'error' END AS action, CASE WHEN login THEN 'signin:ConsoleLogin' ELSE 's3:PutObject' END AS program,
  principal AS "user", acct || '/us-east-1' AS device, CASE k % 3 WHEN 1 THEN 'read' WHEN 2 THEN 'write' END AS severity, CASE WHEN st = 'F' THEN 'Client.UnauthorizedOperation' WHEN st = 'P' AND NOT login THEN 'Throttling' END AS block_reason,
  CASE WHEN c % 5 <> 0 THEN '203.0.113.' || (c % 50) END AS src_ip, CASE WHEN NOT login THEN 'false' WHEN c % 2 = 0 THEN 'Yes' ELSE 'No' END AS mfa, c % 4 = 0 AS from_console FROM ct""")
def _(t):
    done = cloudtrail.normalize_cloudtrail(_records(t), t.profile)
    return done.select("dedup_key", "ts", "kind", "action", "program", "user", "device", "severity", "block_reason", "src_ip", "raw.mfa", "raw.from_console")


@query("s19_extract_targets", "", """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'n1,n' || (o_custkey % 9) || ',b' || (o_custkey % 60) WHEN 1 THEN 'i-' || (o_custkey % 20) ELSE '' END AS targets FROM orders""")
def _(t):
    return _records(t).select(F.col("pos").alias("o_orderkey"), cloudtrail.extract_targets("requestParameters").alias("targets"))


@query("s20_request_text", "", """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '{"bucketName":"b' || (o_custkey % 60) || '","name":["n1",7,"n' || (o_custkey % 9) || '"],"zeta":"z"}'
  WHEN 1 THEN '{"instancesSet":{"items":[{"instanceId":"i-' || (o_custkey % 20) || '"},{"x":1}]},"name":5}' WHEN 2 THEN '{"note":"' || repeat('x', 2100) || '"}' END AS request FROM orders""")
def _(t):
    return _records(t).select(F.col("pos").alias("o_orderkey"), cloudtrail.request_text("requestParameters").alias("request"))


@query("s21_normalize_guardduty", "", f"""SELECT 'gd' || p_partkey AS finding_id, TIMESTAMP '2024-01-01 00:00:00' + p_partkey * INTERVAL 1 SECOND AS ts, p_type AS program,
  CASE WHEN p_size >= 45 THEN 'CRITICAL' WHEN p_size >= 35 THEN 'HIGH' WHEN p_size >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS severity, CASE p_partkey % 3 WHEN 0 THEN '203.0.113.' || (p_partkey % 90) WHEN 1 THEN '198.51.100.' || (p_partkey % 90) END AS src_ip,
  '10.10.0.' || (p_partkey % 200) AS dst_ip, CASE p_partkey % 3 WHEN 0 THEN 443 WHEN 1 THEN 22 END::BIGINT AS dst_port, CASE WHEN p_partkey % 3 = 2 THEN 'bad.example' END AS domain, p_partkey % 4 = 0 OR p_partkey % 10 = 0 AS sample, 'lan' AS dst_zone FROM part""")
def _(t):
    k = F.col("p_partkey")
    net = lambda ip, port: _cat('{"RemoteIpDetails":{"IpAddressV4":"', ip, '"},"LocalPortDetails":{"Port":', port, "}}")
    action = (
        F.when(k % 3 == 0, _cat('{"NetworkConnectionAction":', net(_cat("203.0.113.", k % 90), 443), "}"))
        .when(k % 3 == 1, _cat('{"PortProbeAction":{"PortProbeDetails":[', net(_cat("198.51.100.", k % 90), 22), "]}}"))
        .otherwise('{"DnsRequestAction":{"Domain":"bad.example"}}')
    )
    at = F.date_format(F.timestamp_add("SECOND", k, F.lit("2024-01-01 00:00:00").cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = _cat(
        '{"Id":"gd', k, '","Type":"', F.col("p_type"), '","Severity":', F.col("p_size") / 5.0, ',"Title":"', F.when(k % 10 == 0, "[SAMPLE] x").otherwise("y"), '","',
        F.when(k % 2 == 0, "UpdatedAt").otherwise("CreatedAt"), '":"', at, '","Resource":{"InstanceDetails":{"NetworkInterfaces":[{"PrivateIpAddress":"10.10.0.', k % 200, '"}]}},',
        '"Service":{"AdditionalInfo":{"Sample":', F.when(k % 4 == 0, "true").otherwise("false"), '},"Action":', action, "}}",
    )
    findings = t.raw("part").select(F.from_json(text, guardduty.FINDING_SCHEMA).alias("f")).select("f.*")
    done = guardduty.normalize_guardduty(findings, t.profile)
    return done.select("raw.finding_id", "ts", "program", "severity", "src_ip", "dst_ip", "dst_port", "domain", "raw.sample", "dst_zone")


@query("s22_finding_severity_label", "", """SELECT p_partkey, CASE WHEN p_size >= 45 THEN 'CRITICAL' WHEN p_size >= 35 THEN 'HIGH' WHEN p_size >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS label FROM part""")
def _(t):
    return t.raw("part").select("p_partkey", scalars.finding_severity_label(F.col("p_size") / 5.0).alias("label"))


# ----- keys, duplicates, windows, zones


@query("s23_dedup_key", "", """SELECT o_orderkey, 'feed:' || substr(sha1('feed|' || o_custkey || '|' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END || '|' || o_orderkey), 1, 20) AS key FROM orders""")
def _(t):
    part = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority"))
    return t.raw("orders").select("o_orderkey", scalars.dedup_key("feed", F.col("o_custkey"), part, F.col("o_orderkey")).alias("key"))


@query("s24_dedup_events", "fw", """SELECT dedup_key, id, src_ip, 'last' AS kept FROM (SELECT src_ip || dst_port AS dedup_key, id, src_ip, row_number() OVER (PARTITION BY src_ip || dst_port ORDER BY ts DESC, dedup_key DESC) AS r FROM fw) WHERE r = 1
  UNION ALL SELECT dedup_key, id, src_ip, 'first' FROM (SELECT src_ip || dst_port AS dedup_key, id, src_ip, row_number() OVER (PARTITION BY src_ip || dst_port ORDER BY ts, dedup_key) AS r FROM fw) WHERE r = 1""")
def _(t):
    rows = t.fw.select(F.concat("src_ip", _s("dst_port")).alias("key"), "id", "src_ip", "ts", "dedup_key")
    both = [common.dedup_events(rows, ["ts", "dedup_key"], keep=k, key="key").withColumn("kept", F.lit(k)) for k in ("last", "first")]
    return both[0].unionByName(both[1]).select(F.col("key").alias("dedup_key"), "id", "src_ip", "kept")


@query("s25_clamp_window", "dns", """SELECT count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM dns WHERE ts BETWEEN TIMESTAMP '2024-01-19 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'""")
def _(t):
    utc = timezone.utc
    window = Window(datetime(2024, 1, 1, tzinfo=utc), datetime(2024, 1, 20, tzinfo=utc)).clamp(24)
    return q.time_bounds(t.dns.where(window.contains())).select(t.dns.where(window.contains()).agg(F.count("*")).scalar().alias("n"), "first_ts", "last_ts")


@query("s26_assign_zones", "fw dns", f"""SELECT src_zone, dst_zone, count(*) AS n FROM (SELECT {zone_sql('src_ip')} AS src_zone, {zone_sql('dst_ip')} AS dst_zone FROM fw UNION ALL SELECT {zone_sql('client_ip')}, NULL FROM dns) GROUP BY 1, 2""")
def _(t):
    rows = t.fw.unionByName(t.dns).drop("src_zone", "dst_zone")
    return common.assign_zones(rows, t.profile).groupBy("src_zone", "dst_zone").agg(F.count("*").alias("n"))


# ----- lists, profile, devices


def _list_rows(t) -> DataFrame:
    """List rows of every sort, from the part table."""
    k = F.col("p_partkey")
    kind = k % 10
    raw = (
        F.when(kind == 0, _cat("203[.]0[.]113[.]", k % 250)).when(kind == 1, _cat("198.", k % 200, ".77.5/16")).when(kind == 2, _cat("hxxps://Bad", k % 90, ".Example[.]com:8443/x"))
        .when(kind == 3, _cat("*.sub", k % 90, ".example.net")).when(kind == 4, "10.0.0.0/7").when(kind == 5, "not a name").when(kind == 6, _cat("2001:DB8:0:0:0:0:", F.hex(k % 4000), ":1"))
        .when(kind == 7, "deadbeef").when(kind == 8, _cat("10.9.8.", k % 200)).otherwise(" ")
    )
    none = F.lit(None).cast("string")
    return t.raw("part").select(
        raw.alias("indicator"), F.when(kind == 7, "sha256").when(kind == 8, "IPv4").alias("type"), F.when(k % 3 == 0, _pick(("t1", "T2", "T9"), k % 9 / 3)).alias("tier"),
        F.when(k % 2 == 0, _pick(("low", "HIGH", "??"), k % 3)).alias("severity"), F.col("p_name").alias("source"), none.alias("campaign"), none.alias("warning"),
        F.when(k % 20 == 8, "2020-01-01").when(k % 20 == 0, "2099-01-01T00:00").alias("until"), F.lit("list.csv").alias("origin"), k.alias("_row"), F.lit(0).alias("_file"),
    )


_LISTED = """listed AS (SELECT p_partkey AS k, p_partkey % 10 AS s, CASE p_partkey % 10 WHEN 0 THEN '203.0.113.' || (p_partkey % 250) WHEN 1 THEN '198.' || (p_partkey % 200) || '.0.0/16' WHEN 2 THEN 'bad' || (p_partkey % 90) || '.example.com'
    WHEN 3 THEN 'sub' || (p_partkey % 90) || '.example.net' WHEN 6 THEN (CASE WHEN p_partkey % 4000 = 0 THEN '2001:db8::1' ELSE '2001:db8::' || lower(to_hex(p_partkey % 4000)) || ':1' END) WHEN 8 THEN '10.9.8.' || (p_partkey % 200) END AS value,
  ['ip', 'cidr', 'domain', 'domain_suffix', NULL, NULL, 'ip', NULL, 'ip', NULL][p_partkey % 10 + 1] AS kind,
  CASE WHEN p_partkey % 9 = 0 THEN 4 WHEN p_partkey % 9 = 3 THEN 3 WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 1 THEN 3 ELSE 1 END AS severity,
  CASE p_partkey % 10 WHEN 4 THEN 'invalid' WHEN 5 THEN 'invalid' WHEN 7 THEN 'skipped' WHEN 9 THEN 'blank' ELSE (CASE WHEN p_partkey % 20 = 8 THEN 'expired' ELSE 'usable' END) END AS status FROM part)"""


@query("s27_load_ioc_lists", "", f"""WITH {_LISTED} SELECT value, kind, max(severity)::BIGINT AS severity FROM listed WHERE status = 'usable' GROUP BY value, kind""")
def _(t):
    return lists.indicators_of(lists.classify(_list_rows(t), date(2024, 1, 1))).select("value", "kind", "severity")


@query("s27_list_summary", "", f"""WITH {_LISTED} SELECT status, CASE WHEN status = 'skipped' THEN 'sha256' ELSE '' END AS detail, count(*) AS n FROM listed WHERE status <> 'blank' GROUP BY 1, 2""")
def _(t):
    return lists.list_summary(lists.classify(_list_rows(t), date(2024, 1, 1)))


@query("d16_normalize_indicator", "", f"""WITH {_LISTED} SELECT k, value FROM listed""")
def _(t):
    raw = domains.refang("indicator")
    rows = _list_rows(t).select(F.col("_row").alias("k"), raw.alias("raw"), F.lower("type").alias("type"))
    kind = F.when(F.col("type").isNotNull(), scalars.lookup(F.col("type"), lists.TYPE_NAMES)).otherwise(lists.infer_kind(F.col("raw")))
    return rows.select("k", lists.normalize_indicator(F.col("raw"), kind).alias("value"))


@query("s28_load_profile", "dns", """SELECT z.name, z.trust, z.cidr, count(client_ip) AS n FROM (VALUES ('lan', 'trusted', '10.10.0.0/24'), ('lan', 'trusted', 'fd00:10::/64'), ('iot', 'untrusted', '10.10.50.0/24'), ('dmz', 'semi-trusted', '10.10.15.0/24')) z(name, trust, cidr)
  LEFT JOIN dns ON dns.src_zone = z.name GROUP BY 1, 2, 3""")
def _(t):
    dims = t.profile.dimension_frames(t.spark)
    counts = t.dns.groupBy(F.col("src_zone").alias("zone")).agg(F.count("*").alias("n"))
    zones = dims["zones"].select("name", "trust").join(dims["networks"], F.col("name") == F.col("zone"))
    return zones.join(counts, "zone", "left").select("name", "trust", "cidr", F.coalesce("n", F.lit(0)).alias("n"))


@query("s29_device_directory", "dns", """WITH inv AS (SELECT '10.10.0.' || s_suppkey AS ip, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS hostname, 'hw' || (s_suppkey % 5) AS hardware FROM supplier),
  dhcp AS (SELECT '10.10.50.' || (o_custkey % 200) AS ip, min('host' || o_custkey) AS hostname, min('02:ab:cd:00:00:' || lpad(lower(to_hex(o_custkey % 256)), 2, '0')) AS mac FROM orders WHERE o_orderkey % 12 = 4 AND o_custkey % 3 > 0 AND o_orderkey % 50 <> 7 GROUP BY 1),
  cl AS (SELECT client_ip AS ip, 'c-' || client_ip AS hostname FROM dns GROUP BY 1), ips AS (SELECT ip FROM inv UNION SELECT ip FROM dhcp UNION SELECT ip FROM cl)
  SELECT ip, coalesce(inv.hostname, dhcp.hostname, cl.hostname) AS hostname, hardware, mac, concat_ws(',', CASE WHEN dhcp.ip IS NOT NULL THEN 'dhcp-client' END, CASE WHEN cl.ip IS NOT NULL THEN 'dns-client' END, CASE WHEN inv.ip IS NOT NULL THEN 'managed' END) AS roles,
  concat_ws(',', CASE WHEN cl.ip IS NOT NULL THEN 'resolver' END, CASE WHEN inv.ip IS NOT NULL OR dhcp.ip IS NOT NULL THEN 'syslog' END) AS sources FROM ips LEFT JOIN inv USING (ip) LEFT JOIN dhcp USING (ip) LEFT JOIN cl USING (ip)""")
def _(t):
    s = F.col("s_suppkey")
    inventory = t.raw("supplier").select(
        F.explode(F.array(_cat("10.10.0.", s), _cat("8.8.8.", s))).alias("ip"), F.when(s % 2 == 0, F.col("s_name")).alias("hostname"), _cat("hw", s % 5).alias("hardware")
    )
    clients = t.dns.select(F.col("client_ip").alias("ip")).distinct().withColumn("hostname", _cat("c-", F.col("ip")))
    table = devices.device_directory(devices.managed_devices(inventory), devices.dhcp_devices(_events(t)), devices.dns_devices(clients))
    return table.select("ip", "hostname", "hardware", "mac", "roles", "sources")


# ----- sinks


@query("k01_append_events", "fw dns", """SELECT run_id, kind, count(*) AS n, count(DISTINCT dedup_key) AS keys FROM (SELECT 'run1' AS run_id, kind, dedup_key FROM fw UNION ALL SELECT 'run2', kind, dedup_key FROM dns) GROUP BY 1, 2""")
def _(t):
    """Two runs written, the second one twice: a repeated write replaces its own partitions."""
    root = scratch_path(t.spark, "tables")
    sinks.append_events(t.fw, root, "run1")
    for _ in range(2):
        sinks.append_events(t.dns, root, "run2")
    stored = sinks.read_events(t.spark, root)
    return stored.groupBy("run_id", "kind").agg(F.count("*").alias("n"), F.count_distinct("dedup_key").alias("keys"))


@query("k02_save_metrics", "", """SELECT o_orderkey, round(CASE WHEN o_orderkey % 4 < 2 THEN o_totalprice END, 6) AS value_num, CASE o_orderkey % 4 WHEN 2 THEN 'true' WHEN 3 THEN o_orderpriority END AS value_text FROM orders""")
def _(t):
    k = F.col("o_orderkey")
    value = F.when(k % 4 < 2, _s("o_totalprice")).when(k % 4 == 2, "true").otherwise(F.col("o_orderpriority"))
    return sinks.split_value(t.raw("orders").select("o_orderkey", value.alias("v")), "v").drop("v")


@query("k03_save_products", "fw findings", """SELECT * FROM (SELECT 'findings' AS product, 'run9' AS run_id, count(*) AS n FROM findings
  UNION ALL SELECT 'signals', 'run9', count(*) FROM (SELECT src_ip FROM fw WHERE action = 'drop' AND proto = 'udp' GROUP BY src_ip HAVING min(ttl) <= 8 AND max(ttl) - min(ttl) >= 2 AND count(*) >= 10)
  UNION ALL SELECT 'metrics', 'run9', count(*) FROM part UNION ALL SELECT 'source_health', 'run9', count(*) FROM supplier
  UNION ALL SELECT 'findings', 'run8', count(*) FROM findings WHERE severity >= 3) WHERE n > 0""")
def _(t):
    """Run 8 is done again without signals, run 9 dies between two tables after it was finished once."""
    store = RunStore(t.spark, scratch_path(t.spark, "products"))
    signals, parts, sources = stepped_ttl(t.fw, min_spread=2), t.raw("part"), t.raw("supplier")
    health = sources.select(F.col("s_name").alias("source"), F.lit("OK").alias("state"), F.col("s_suppkey").cast("bigint").alias("records"))
    for products in (("findings", "signals"), ("findings",)):
        run = store.begin("run8", AS_OF)
        run.write("findings", t.findings.where("severity >= 3").withColumn("ts", F.lit(AS_OF).cast("timestamp")))
        if "signals" in products:
            run.signals(signals)
        run.commit(AS_OF)
    run = store.begin("run9", AS_OF)
    run.write("findings", t.findings)
    run.signals(signals)
    run.metrics(parts.select(_cat("m", F.col("p_partkey")).alias("key"), F.col("p_size").cast("double").alias("value_num")), AS_OF)
    run.write("source_health", health)
    run.commit(AS_OF)
    store.begin("run9", AS_OF).write("findings", t.findings.limit(1))
    found = [store.read(name).groupBy("run_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("product"), "run_id", "n") for name in ("findings", "signals", "metrics", "source_health", "canaries")]
    return reduce(DataFrame.unionByName, found)


_AGES = (800, 200, 100, 1)


def _stored_runs(t) -> RunStore:
    """Runs that began so many days ago, with a quarter of the traffic, all names looked up, and a metric for each part."""
    store, now = RunStore(t.spark, scratch_path(t.spark, "runs")), datetime.fromisoformat(AS_OF)
    for k, age in enumerate(_AGES):
        start = now - timedelta(days=age)
        run = store.begin(f"run{k}", start)
        run.events(t.fw.where(F.col("dst_port") % 4 == k))
        run.metrics(t.raw("part").where(F.col("p_size") % 4 >= k).select(_cat("m", F.col("p_partkey")).alias("key"), F.col("p_size").cast("double").alias("value_num")), start)
        run.write("ioc_dns", H.build_ioc_dns(t.dns, f"run{k}", start.date().isoformat()))
        run.commit(start + timedelta(hours=1))
    return store


def _stored_counts(store: RunStore) -> DataFrame:
    found = [store.read(name).groupBy("run_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "run_id", "n") for name in ("events", "metrics", "ioc_dns")]
    return reduce(DataFrame.unionByName, found)


_STORED = """runs AS (SELECT * FROM (VALUES (0, 800), (1, 200), (2, 100), (3, 1)) v(k, age)),
kept AS (SELECT 'events' AS what, k, age, count(*) AS n FROM runs JOIN fw ON dst_port % 4 = k GROUP BY k, age UNION ALL SELECT 'metrics', k, age, count(*) FROM runs JOIN part ON p_size % 4 >= k GROUP BY k, age
  UNION ALL SELECT 'ioc_dns', k, age, (SELECT count(*) FROM (SELECT DISTINCT client_ip, domain FROM dns)) FROM runs)"""


@query("k08_purge", "fw dns", f"""WITH {_STORED} SELECT what, 'run' || k AS run_id, n FROM kept WHERE age <= CASE what WHEN 'events' THEN 7 WHEN 'ioc_dns' THEN 180 ELSE 730 END""")
def _(t):
    store = _stored_runs(t)
    store.purge(datetime.fromisoformat(AS_OF))
    return _stored_counts(store)


@query("k09_delete_run", "fw dns", f"""WITH {_STORED} SELECT what, 'run' || k AS run_id, n FROM kept WHERE k <> 2""")
def _(t):
    store = _stored_runs(t)
    store.delete_run("run2")
    return _stored_counts(store)


@query("k11_evolve_schema", "fw", """SELECT kind, count(*) AS n, count(DISTINCT src_ip) AS sources, 0::BIGINT AS with_domain FROM fw GROUP BY kind""")
def _(t):
    old = t.fw.drop("domain", "raw", "upstream").select(*sorted(set(t.fw.columns) - {"domain", "raw", "upstream"}))
    new = sinks.evolve_schema(old)
    return new.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("src_ip").alias("sources"), F.count("domain").alias("with_domain"))


@query("r01_register_views", "dns", """SELECT domain, count(*) AS n FROM dns WHERE blocked GROUP BY domain""")
def _(t):
    """Ad-hoc SQL over views: rows of another run are out of reach."""
    mine = t.dns.withColumn("run_id", F.lit("run1")).unionByName(t.dns.withColumn("run_id", F.lit("run2")))
    sinks.register_views(t.spark, {"events": mine, "metrics": t.metrics}, "run1")
    return sinks.run_sql(t.spark, "SELECT domain, count(*) AS n FROM events WHERE blocked GROUP BY domain", 1000)


@query("r02_query", "metrics", """SELECT key, count(*) AS n, round(max(value_num), 6) AS top FROM metrics GROUP BY key ORDER BY n DESC, key LIMIT 3""")
def _(t):
    sinks.register_views(t.spark, {"metrics": t.metrics}, "run1")
    return sinks.run_sql(t.spark, "SELECT key, count(*) AS n, max(value_num) AS top FROM metrics GROUP BY key ORDER BY n DESC, key", 3)


# ----- streams


def _stream(t, table: str) -> DataFrame:
    return jobs.read_files(t.spark, t.sf_dir, t.raw(table).schema, pathGlobFilter=f"{table}.parquet")


def _finish(job) -> None:
    job.awaitTermination()


def _appended(t, df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(t.spark, name)
    _finish(jobs.batches_to(df, f"{path}/rows", f"{path}/state"))
    return BatchTable(t.spark, f"{path}/rows").read()


def _totals(t, df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    path = scratch_path(t.spark, name)
    _finish(jobs.totals_to(df, f"{path}/rows", f"{path}/state", keys))
    return jobs.read_totals(t.spark, f"{path}/rows", keys)


class _StreamTables:
    """The views of ``Tables`` over a stream of one table."""

    def __init__(self, t, table: str) -> None:
        from sentrylake.plans.tables import Tables

        self.view = Tables(t.spark, t.sf_dir)
        stream = _stream(t, table)
        self.view.raw = lambda name: stream  # type: ignore[method-assign]


@query("z01_stream_normalize", "", f"""WITH {PARSED} SELECT kind, action, count(*) AS n FROM lined GROUP BY kind, action""")
def _(t):
    path = scratch_path(t.spark, "landed-lines")
    lines_of(t).write.parquet(path)
    lines = jobs.read_files(t.spark, path, t.spark.read.parquet(path).schema)
    events = jobs.stream_normalize(lines, t.profile).select("ts", "kind", "action", "dedup_key")
    return _appended(t, events, "stream-normalize").groupBy("kind", "action").agg(F.count("*").alias("n"))


@query("z02_stream_dedup", "wifi", """SELECT action, count(*) AS n, count(DISTINCT dedup_key) AS keys FROM wifi GROUP BY action""")
def _(t):
    events = _StreamTables(t, "events").view.wifi
    twice = events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).select("ts", "action", "dedup_key")
    rows = _appended(t, jobs.stream_dedup(twice), "stream-dedup")
    return rows.groupBy("action").agg(F.count("*").alias("n"), F.count_distinct("dedup_key").alias("keys"))


@query("z03_stream_hourly_counts", "wifi", """SELECT date_trunc('hour', ts) AS hour, kind, count(*) AS n FROM wifi GROUP BY 1, 2""")
def _(t):
    counts = jobs.stream_hourly_counts(_StreamTables(t, "events").view.wifi, ["kind"])
    return _totals(t, counts, "stream-hours", ["hour", "kind"])


@query("z04_stream_failure_burst", "ssh", """WITH f AS (SELECT src_ip, ts, unnest(range(0, 10)) AS i FROM ssh WHERE action IN ('ssh_failed', 'ssh_invalid'))
  SELECT date_trunc('minute', ts) - i * INTERVAL 1 MINUTE AS window_start, src_ip, count(*) AS n FROM f GROUP BY 1, 2""")
def _(t):
    ssh = _StreamTables(t, "orders").view.ssh
    return _totals(t, jobs.stream_failure_burst(ssh, ["ssh_failed", "ssh_invalid"]), "stream-bursts", ["window_start", "src_ip"])


@query("z05_stream_entities", "ssh", """SELECT etype, value, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS occurrences FROM (SELECT 'ip' AS etype, src_ip AS value, ts FROM ssh UNION ALL SELECT 'user', "user", ts FROM ssh) GROUP BY 1, 2""")
def _(t):
    ssh = _StreamTables(t, "orders").view.ssh
    return jobs.merge_days(_totals(t, jobs.stream_entities(ssh), "stream-entities", ["day", "etype", "value"]))
