"""Registered queries: predicates, scalar functions and the read-side aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentrylake.functions import domains, net, scalars
from sentrylake.operators import query as q
from sentrylake.plans.registry import query

# ----- predicates


@query("p01_scope", "fw ssh", """
SELECT source, kind, count(*) AS n FROM (SELECT source, kind FROM fw UNION ALL SELECT source, kind FROM ssh)
WHERE source IN ('syslog') AND source NOT IN ('canary') GROUP BY source, kind""")
def _(t):
    rows = q.scope(t.fw.unionByName(t.ssh).unionByName(t.dns), only_sources=["syslog"], exclude_sources=["canary"])
    return rows.groupBy("source", "kind").agg(F.count("*").alias("n"))


@query("p02_where", "fw", """
SELECT action, dst_port::BIGINT AS dst_port, count(*) AS n FROM fw
WHERE proto = 'tcp' AND dst_port IN (22, 3389) GROUP BY action, dst_port""")
def _(t):
    rows = q.where(t.fw, proto="tcp", dst_port=[22, 3389], iface_in=None)
    return rows.groupBy("action", "dst_port").agg(F.count("*").alias("n"))


@query("p03_touching_zone", "fw", """
SELECT src_zone, dst_zone, count(*) AS n FROM fw WHERE src_zone = 'lan' OR dst_zone = 'lan' GROUP BY src_zone, dst_zone""")
def _(t):
    return q.touching_zone(t.fw, "lan").groupBy("src_zone", "dst_zone").agg(F.count("*").alias("n"))


@query("p04_detail_rows", "cloud", """
SELECT id, ts, program, "user", request FROM cloud
WHERE (program IN ('kms:DisableKey', 'cloudtrail:StopLogging') OR lower(program) LIKE 'iam:list%')
  AND lower("user") LIKE '%user/u7' AND (lower(raw_json) LIKE '%zone-1%' OR lower("user") LIKE '%zone-1%')""")
def _(t):
    rows = q.detail_rows(
        t.cloud, programs=["kms:DisableKey", "cloudtrail:StopLogging"], program_prefixes=["IAM:List"],
        user_suffix="USER/u7", raw_contains="ZONE-1",
    )
    return rows.select("id", "ts", "program", "user", F.col("raw.request").alias("request"))


def _needs() -> str:
    """What each detector needs, as SQL rows."""
    from sentrylake.plans.daily import DETECTORS

    text = lambda names: "[" + ", ".join(f"'{n}'" for n in sorted(names)) + "]::VARCHAR[]"
    return ", ".join(f"('{d.name}', {text(d.kinds)}, {text(d.sources)})" for d in DETECTORS)


@query("p05_applicable", "fw dns ssh gd", f"""WITH days AS (SELECT DISTINCT day_of, kind, source FROM (SELECT 'quiet' AS day_of, kind, source FROM dns UNION ALL SELECT 'busy', kind, source FROM fw UNION ALL SELECT 'busy', kind, source FROM gd
  UNION ALL SELECT 'logons', kind, source FROM ssh)), need(detector, kinds, sources) AS (VALUES {_needs()})
SELECT day_of, detector FROM (SELECT day_of, list(DISTINCT kind) AS have, list(DISTINCT source) AS froms FROM days GROUP BY day_of), need
WHERE (len(kinds) = 0 OR list_has_any(kinds, have)) AND (len(sources) = 0 OR list_has_any(sources, froms))""")
def _(t):
    """Detectors that days of different events call for."""
    from sentrylake.plans.daily import applicable_detectors

    days = {"quiet": t.dns, "busy": t.fw.unionByName(t.gd), "logons": t.ssh}
    found = [applicable_detectors(rows).select(F.lit(day).alias("day_of"), "detector") for day, rows in days.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("p06_kinds_and_sources", "fw dns ssh gd", """
SELECT DISTINCT kind, source FROM (SELECT kind, source FROM fw UNION ALL SELECT kind, source FROM dns
UNION ALL SELECT kind, source FROM ssh UNION ALL SELECT kind, source FROM gd)""")
def _(t):
    rows = t.fw.unionByName(t.dns).unionByName(t.ssh).unionByName(t.gd)
    kinds, sources = q.kinds_present(rows), q.sources_present(rows)
    pairs = rows.select("kind", "source").distinct()
    return pairs.join(kinds, "kind", "left_semi").join(sources, "source", "left_semi")


@query("p07_return_traffic", "fw", """
SELECT src_ip, count(*) AS n FROM fw WHERE proto = 'tcp' AND src_port IN (80, 443) GROUP BY src_ip""")
def _(t):
    return t.fw.where(q.is_return_traffic()).groupBy("src_ip").agg(F.count("*").alias("n"))


@query("p08_existing_event_ids", "fw", """
SELECT DISTINCT p_partkey AS id FROM part WHERE p_partkey IN (SELECT id FROM fw WHERE action = 'drop')""")
def _(t):
    return q.existing_event_ids(q.where(t.fw, action="drop"), t.raw("part").select(F.col("p_partkey").alias("id")))


# ----- scalar functions

# Addresses of every sort, valid and not, from the keys of a table.
_ADDRESSES = """SELECT DISTINCT ip FROM (SELECT CASE l_orderkey % 6
  WHEN 0 THEN (l_partkey % 260) || '.' || (l_suppkey % 256) || '.' || (l_orderkey % 256) || '.' || l_linenumber
  WHEN 1 THEN '10.10.' || (l_suppkey % 60) || '.' || (l_partkey % 256)
  WHEN 2 THEN (CASE l_suppkey % 8 WHEN 0 THEN '172.' || (l_partkey % 40) WHEN 1 THEN '192.168' WHEN 2 THEN '169.254'
      WHEN 3 THEN '198.18' WHEN 4 THEN '198.51' WHEN 5 THEN '203.0' WHEN 6 THEN '192.0' ELSE '100.' || (l_partkey % 130) END)
      || '.' || (l_partkey % 120) || '.' || (l_suppkey % 12)
  WHEN 3 THEN '0' || (l_partkey % 9) || '.1.2.3' WHEN 4 THEN '10.10.0' WHEN 5 THEN 'host-' || l_suppkey END AS ip FROM lineitem)"""
_OK = "regexp_full_match(ip, '(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}')"
_VAL = ("(CAST(split_part(ip,'.',1) AS BIGINT)*16777216 + CAST(split_part(ip,'.',2) AS BIGINT)*65536"
        " + CAST(split_part(ip,'.',3) AS BIGINT)*256 + CAST(split_part(ip,'.',4) AS BIGINT))")


def _net(cidr: str) -> str:
    import ipaddress

    n = ipaddress.ip_network(cidr)
    return f"v BETWEEN {int(n.network_address)} AND {int(n.broadcast_address)}"


def _any(cidrs) -> str:
    return "(" + " OR ".join(_net(c) for c in cidrs if ":" not in c) + ")"


def _address_frame(t):
    li = t.raw("lineitem")
    o, p, s, n = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    x = lambda c: c.cast("string")
    dot = F.lit(".")
    head = (
        F.when(s % 8 == 0, F.concat(F.lit("172."), x(p % 40))).when(s % 8 == 1, "192.168").when(s % 8 == 2, "169.254")
        .when(s % 8 == 3, "198.18").when(s % 8 == 4, "198.51").when(s % 8 == 5, "203.0").when(s % 8 == 6, "192.0")
        .otherwise(F.concat(F.lit("100."), x(p % 130)))
    )
    ip = (
        F.when(o % 6 == 0, F.concat(x(p % 260), dot, x(s % 256), dot, x(o % 256), dot, x(n)))
        .when(o % 6 == 1, F.concat(F.lit("10.10."), x(s % 60), dot, x(p % 256)))
        .when(o % 6 == 2, F.concat(head, dot, x(p % 120), dot, x(s % 12)))
        .when(o % 6 == 3, F.concat(F.lit("0"), x(p % 9), F.lit(".1.2.3")))
        .when(o % 6 == 4, "10.10.0")
        .otherwise(F.concat(F.lit("host-"), x(s)))
    )
    return li.select(ip.alias("ip")).distinct()


_ZONED = f"""addresses AS ({_ADDRESSES}), valued AS (SELECT ip, CASE WHEN {_OK} THEN {_VAL} END AS v FROM addresses),
zoned AS (SELECT ip, v, CASE WHEN v IS NULL THEN NULL WHEN {_net('10.10.0.0/24')} THEN 'lan' WHEN {_net('10.10.50.0/24')} THEN 'iot'
  WHEN {_net('10.10.15.0/24')} THEN 'dmz' WHEN {_any(net.LOCAL_RANGES)} THEN 'private' ELSE 'external' END AS zone FROM valued)"""


@query("d01_zone_of", "", f"WITH {_ZONED} SELECT ip, zone FROM zoned")
def _(t):
    return _address_frame(t).withColumn("zone", t.profile.zone_of("ip"))


@query("d02_is_internal", "", f"WITH {_ZONED} SELECT ip, coalesce(zone <> 'external', false) AS internal FROM zoned")
def _(t):
    return _address_frame(t).withColumn("internal", t.profile.is_internal("ip"))


@query("d03_is_external", "", f"WITH {_ZONED} SELECT ip, coalesce(zone = 'external', false) AS outside FROM zoned")
def _(t):
    return _address_frame(t).withColumn("outside", t.profile.is_external("ip"))


@query("d04_is_routable", "", f"""WITH {_ZONED} SELECT ip, coalesce(NOT {_any(net.SPECIAL_V4)} AND NOT {_any(net.SHARED_V4)}
  OR {_any(net.SPECIAL_V4_EXCEPT)}, false) AS routable FROM zoned""")
def _(t):
    return _address_frame(t).withColumn("routable", F.coalesce(net.is_routable("ip"), F.lit(False)))


@query("d05_is_benign_domain", "dns", """
SELECT domain, count(*) AS n, bool_or(domain = 'the.example.com' OR domain = 'example.org' OR domain LIKE '%.example.org'
  OR domain = 'local' OR domain LIKE '%.local') AS benign FROM dns GROUP BY domain""")
def _(t):
    return (
        t.dns.groupBy("domain").agg(F.count("*").alias("n"))
        .withColumn("benign", t.profile.is_benign_domain("domain"))
    )


@query("d06_label_for", "fw", """
SELECT ip, CASE ip WHEN '10.10.0.1' THEN '10.10.0.1 (edge)' WHEN '10.10.0.69' THEN '10.10.0.69 (resolver)'
  WHEN '10.10.50.7' THEN '10.10.50.7 (camera)' ELSE ip END AS label
FROM (SELECT DISTINCT src_ip AS ip FROM fw UNION SELECT DISTINCT dst_ip FROM fw)""")
def _(t):
    ips = q.all_traffic_ips(t.fw).select(F.col("value").alias("ip"))
    return ips.withColumn("label", t.profile.label_for("ip"))


_CAVEAT = """CASE client_ip WHEN '10.10.0.10' THEN {iot} WHEN '10.10.0.4' THEN {dmz} ELSE '' END"""


def _caveat(ip: str, zone: str) -> str:
    return (
        f"'{ip} stands for every device of {zone}: their traffic is NATed there, and no collected "
        f"source says which of them sent it.'"
    )


CAVEAT_SQL = _CAVEAT.format(iot=_caveat("10.10.0.10", "iot"), dmz=_caveat("10.10.0.4", "dmz"))


@query("d07_attribution_caveat", "dns", f"SELECT DISTINCT client_ip, {CAVEAT_SQL} AS caveat FROM dns")
def _(t):
    return t.dns.select("client_ip").distinct().withColumn("caveat", t.profile.attribution_caveat("client_ip"))


# Names under every sort of suffix, from the page hosts.
_NAMES = """names AS (SELECT DISTINCT CASE page_id % 5 WHEN 0 THEN host WHEN 1 THEN replace(host, '.com', '.co.uk')
  WHEN 2 THEN host || '.' WHEN 3 THEN split_part(host, '.', 1) ELSE 'a.' || split_part(host, '.', 1) || '.com.au' END AS name
  FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages))"""
_TWO = ", ".join(f"'{s}'" for s in domains.TWO_LABEL_SUFFIXES)


def _name_frame(t):
    host = F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
    first = F.split_part(host, F.lit("."), F.lit(1))
    p = F.col("page_id") % 5
    name = (
        F.when(p == 0, host).when(p == 1, F.replace(host, F.lit(".com"), F.lit(".co.uk")))
        .when(p == 2, F.concat(host, F.lit("."))).when(p == 3, first)
        .otherwise(F.concat(F.lit("a."), first, F.lit(".com.au")))
    )
    return t.raw("pages").select(name.alias("name")).distinct()


@query("d08_apex_domain", "", f"""WITH {_NAMES}, parts AS (SELECT name, string_split(rtrim(name, '.'), '.') AS p FROM names)
SELECT name, CASE WHEN len(p) < 2 THEN name WHEN len(p) >= 3 AND p[-2] || '.' || p[-1] IN ({_TWO})
  THEN p[-3] || '.' || p[-2] || '.' || p[-1] ELSE p[-2] || '.' || p[-1] END AS apex FROM parts""")
def _(t):
    return _name_frame(t).withColumn("apex", domains.apex_domain("name"))


_ENTROPY = ("-list_sum(list_transform(list_distinct(string_split({s}, '')), lambda ch: "
            "((length({s}) - length(replace({s}, ch, ''))) / length({s})::DOUBLE) * "
            "log2((length({s}) - length(replace({s}, ch, ''))) / length({s})::DOUBLE)))")


@query("d09_shannon_entropy", "dns", f"""SELECT domain, round({_ENTROPY.format(s='domain')}, 6) AS entropy
FROM (SELECT DISTINCT domain FROM dns)""")
def _(t):
    return t.dns.select("domain").distinct().withColumn("entropy", domains.shannon_entropy("domain"))


GENERATED_SQL = f"""(label IS NOT NULL AND {_ENTROPY.format(s='label')} >= 3.6 AND
  (length(regexp_replace(label, '[^aeiou]', '', 'g')) / length(label)::DOUBLE < 0.25
   OR length(regexp_replace(label, '[^0-9]', '', 'g')) / length(label)::DOUBLE > 0.3))"""
LABEL_SQL = """CASE WHEN domain LIKE '%.%' AND regexp_full_match(split_part(domain, '.', 1), '[a-z0-9-]{12,}')
  THEN split_part(domain, '.', 1) END"""


@query("d10_looks_generated", "dns", f"""SELECT domain, coalesce({GENERATED_SQL}, false) AS suspicious
FROM (SELECT domain, {LABEL_SQL} AS label FROM (SELECT DISTINCT domain FROM dns))""")
def _(t):
    return t.dns.select("domain").distinct().withColumn("suspicious", domains.looks_generated("domain"))


@query("d11_subnet24", "", f"""WITH addresses AS ({_ADDRESSES}) SELECT ip, CASE WHEN len(string_split(ip, '.')) = 4
  THEN split_part(ip,'.',1) || '.' || split_part(ip,'.',2) || '.' || split_part(ip,'.',3) || '.0/24' END AS subnet FROM addresses""")
def _(t):
    return _address_frame(t).withColumn("subnet", net.subnet24("ip"))


@query("d12_ladder_length", "fw", """
WITH per AS (SELECT src_ip, dst_ip, list_sort(list(DISTINCT ttl)) AS ttls FROM fw GROUP BY src_ip, dst_ip)
SELECT src_ip, dst_ip, CASE WHEN ttls[1] > 3 THEN 0 ELSE
  len(list_filter(generate_series(1, len(ttls)), lambda i: ttls[i] - i + 1 = ttls[1])) END::BIGINT AS hops FROM per""")
def _(t):
    from sentrylake.operators.series import ladder_length

    per = t.fw.groupBy("src_ip", "dst_ip").agg(F.collect_set("ttl").alias("ttls"))
    return per.select("src_ip", "dst_ip", ladder_length(F.col("ttls")).alias("hops"))


@query("d13_daypart", "dns", """
SELECT part, count(*) AS n FROM (SELECT ['night','morning','afternoon','evening']
  [CAST(floor(hour(((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')) / 6) AS INTEGER) + 1] AS part FROM dns) GROUP BY part""")
def _(t):
    part = scalars.daypart("ts", "America/New_York")
    return t.dns.groupBy(part.alias("part")).agg(F.count("*").alias("n"))


@query("d14_delta_pct", "", """
SELECT o_custkey, round(CASE WHEN b <> 0 THEN (a - b) / abs(b) * 100 END, 6) AS delta FROM (SELECT o_custkey,
  sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::DOUBLE AS b
  FROM orders GROUP BY o_custkey)""")
def _(t):
    s = F.col("o_orderstatus")
    per = t.raw("orders").groupBy("o_custkey").agg(F.count_if(s == "F").alias("a"), F.count_if(s == "P").alias("b"))
    return per.select("o_custkey", scalars.delta_pct("a", "b").alias("delta"))


# Defanged spellings made from the page addresses.
_DEFANGED = """defanged AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN replace(url, '.', '[.]') WHEN 1 THEN ' ' || replace(url, 'http', 'hxxp')
  WHEN 2 THEN replace(url, '.example', '[dot]example') ELSE replace(replace(url, '.', '(.)'), '://', '[:]//') END AS raw FROM pages)"""


def _defanged_frame(t):
    p, url = F.col("page_id") % 4, F.col("url")
    r = lambda c, a, b: F.replace(c, F.lit(a), F.lit(b))
    raw = (
        F.when(p == 0, r(url, ".", "[.]")).when(p == 1, F.concat(F.lit(" "), r(url, "http", "hxxp")))
        .when(p == 2, r(url, ".example", "[dot]example")).otherwise(r(r(url, ".", "(.)"), "://", "[:]//"))
    )
    return t.raw("pages").select("page_id", raw.alias("raw"))


_REFANG = ("replace(replace(replace(replace(replace(replace(trim(raw), '[.]', '.'), '(.)', '.'), '[dot]', '.'), '[:]', ':'), "
           "'hxxps://', 'https://'), 'hxxp://', 'http://')")


@query("d15_refang", "", f"WITH {_DEFANGED} SELECT page_id, {_REFANG} AS plain FROM defanged")
def _(t):
    return _defanged_frame(t).select("page_id", domains.refang("raw").alias("plain"))


@query("d17_parse_severity", "", """
SELECT o_orderkey, CASE WHEN name IN ('LOW','MEDIUM','HIGH','CRITICAL') THEN (CASE name WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2
  WHEN 'HIGH' THEN 3 ELSE 4 END) ELSE greatest(0, least(4, TRY_CAST(name AS INTEGER))) END::BIGINT AS rank
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN substr(o_orderpriority, 3) ELSE CAST(o_orderkey % 9 - 2 AS VARCHAR) END AS name FROM orders)""")
def _(t):
    k = F.col("o_orderkey")
    name = F.when(k % 2 == 0, F.expr("substr(o_orderpriority, 3)")).otherwise((k % 9 - 2).cast("string"))
    return t.raw("orders").select("o_orderkey", scalars.parse_severity(F.lower(name)).alias("rank"))


@query("d18_mac_shape", "wifi ssh", """
SELECT "user", regexp_full_match("user", '[0-9a-f]{2}(:[0-9a-f]{2}){5}') AS is_mac
FROM (SELECT "user" FROM wifi UNION SELECT "user" FROM ssh) WHERE "user" IS NOT NULL""")
def _(t):
    users = q.distinct_values(t.wifi.unionByName(t.ssh), "user")
    return users.select(F.col("value").alias("user"), scalars.is_mac("value").alias("is_mac"))


@query("d19_human_interval", "", """
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN s < 90 THEN printf('%.0fs', s)
  WHEN s < 5400 THEN printf('%.1fmin', s / 60) ELSE printf('%.1fh', s / 3600) END AS text
FROM (SELECT l_orderkey, l_linenumber, (l_orderkey % 13) * (l_linenumber * 360) + 7.0 AS s FROM lineitem)""")
def _(t):
    s = ((F.col("l_orderkey") % 13) * (F.col("l_linenumber") * 360)).cast("double") + 7.0
    return t.raw("lineitem").select("l_orderkey", "l_linenumber", scalars.human_interval(s).alias("text"))


@query("d20_short_arn", "cloud", """
SELECT DISTINCT "user", CASE WHEN "user" LIKE '%/%' THEN string_split("user", '/')[-1] ELSE string_split("user", ':')[-1] END AS short FROM cloud""")
def _(t):
    return t.cloud.select("user").distinct().withColumn("short", scalars.short_arn("user"))


@query("d21_ip_verdict", "", """
SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN 'benign' WHEN s IS NULL THEN 'unknown' WHEN s >= 80 THEN 'malicious'
  WHEN s >= 50 THEN 'suspicious' WHEN s >= 25 THEN 'unknown' ELSE 'benign' END AS verdict
FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_size * 2 END AS s FROM part)""")
def _(t):
    k = F.col("p_partkey")
    score = F.when(k % 7 != 0, F.col("p_size") * 2)
    return t.raw("part").select("p_partkey", scalars.ip_verdict(score, k % 50 == 0).alias("verdict"))


@query("d22_domain_verdict", "", """
SELECT p_partkey, CASE WHEN p_partkey % 40 = 0 OR lev = 'critical' THEN 'malicious' WHEN lev = 'high' THEN 'suspicious'
  WHEN lev = 'medium' THEN 'unknown' WHEN lev = 'low' OR p_size < 25 THEN 'benign' ELSE 'unknown' END AS verdict
FROM (SELECT p_partkey, p_size, ['critical','high','medium','low','none'][p_partkey % 5 + 1] AS lev FROM part)""")
def _(t):
    k = F.col("p_partkey")
    level = F.element_at(F.array(*[F.lit(x) for x in ("critical", "high", "medium", "low", "none")]), (k % 5 + 1).cast("int"))
    return t.raw("part").select("p_partkey", scalars.domain_verdict(k % 40 == 0, level, "p_size").alias("verdict"))


@query("d23_ip_categories", "", """
SELECT p_partkey, concat_ws(',', CASE WHEN p_size % 3 = 0 THEN 'tor-exit' END,
  CASE WHEN u LIKE '%data center%' OR u LIKE '%hosting%' THEN 'datacenter' END,
  CASE WHEN u LIKE '%fixed line isp%' OR u LIKE '%mobile%' THEN 'residential' END) AS categories
FROM (SELECT p_partkey, p_size, lower(['Data Center/Web Hosting','Fixed Line ISP','Mobile ISP hosting','Education'][p_partkey % 4 + 1]) AS u FROM part)""")
def _(t):
    usage = F.element_at(
        F.array(*[F.lit(x) for x in ("Data Center/Web Hosting", "Fixed Line ISP", "Mobile ISP hosting", "Education")]),
        (F.col("p_partkey") % 4 + 1).cast("int"),
    )
    return t.raw("part").select("p_partkey", scalars.ip_categories(F.col("p_size") % 3 == 0, usage).alias("categories"))


@query("d24_is_allowed_action", "fw wifi", """
SELECT action, lower(coalesce(action, '')) NOT IN ('drop','reject','deny','block') AS allowed, count(*) AS n
FROM (SELECT action FROM fw UNION ALL SELECT action FROM wifi) GROUP BY action""")
def _(t):
    rows = t.fw.unionByName(t.wifi).groupBy("action").agg(F.count("*").alias("n"))
    return rows.withColumn("allowed", scalars.is_allowed_action("action"))


# ----- aggregates


@query("a01_count", "fw", "SELECT count(*) AS n FROM fw WHERE action = 'drop' AND proto = 'udp'")
def _(t):
    return q.count(t.fw, action="drop", proto="udp")


@query("a02_count_zone", "fw", "SELECT count(*) AS n FROM fw WHERE (src_zone = 'iot' OR dst_zone = 'iot') AND action = 'drop'")
def _(t):
    return q.count_zone(t.fw, "iot", action="drop")


@query("a03_distinct_count", "dns", "SELECT count(DISTINCT domain) AS n FROM dns WHERE blocked = false")
def _(t):
    return q.distinct_count(t.dns, "domain", blocked=False)


@query("a04_time_bounds", "fw", "SELECT min(ts) AS first_ts, max(ts) AS last_ts FROM fw WHERE action = 'accept'")
def _(t):
    return q.time_bounds(t.fw, action="accept")


@query("a05_top_by_count", "fw", """
SELECT dst_port::BIGINT AS value, count(*) AS n FROM fw WHERE action = 'drop' GROUP BY dst_port ORDER BY n DESC, value LIMIT 15""")
def _(t):
    return q.top(t.fw, "dst_port", action="drop")


@query("a06_top_by_distinct", "fw", """
SELECT dst_port::BIGINT AS value, count(DISTINCT src_ip) AS n FROM fw WHERE action = 'drop' GROUP BY dst_port ORDER BY n DESC, value LIMIT 20""")
def _(t):
    return q.top(t.fw, "dst_port", 20, by="unique:src_ip", action="drop")


@query("a07_group_pairs", "dns", """
SELECT client_ip, domain, count(*) AS n FROM dns GROUP BY client_ip, domain ORDER BY n DESC, client_ip, domain LIMIT 50""")
def _(t):
    return q.group_pairs(t.dns, "client_ip", "domain", 50)


@query("a08_hourly", "dns", "SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM dns GROUP BY 1")
def _(t):
    return q.hourly(t.dns)


@query("a09_hourly_zone", "fw", """
SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM fw WHERE src_zone = 'iot' OR dst_zone = 'iot' GROUP BY 1""")
def _(t):
    return q.hourly_zone(t.fw, "iot")


@query("a10_timestamps_for", "fw", """
SELECT ts FROM fw WHERE src_ip = '198.51.100.4' AND dst_port = 22 ORDER BY ts LIMIT 20000""")
def _(t):
    return q.timestamps_for(t.fw, 20000, src_ip="198.51.100.4", dst_port=22)


@query("a11_distinct_values", "dns", "SELECT DISTINCT domain AS value FROM dns WHERE domain IS NOT NULL AND blocked")
def _(t):
    return q.distinct_values(t.dns, "domain", blocked=True)


@query("a12_sample", "ssh", """
SELECT id, ts, "user", src_ip, action FROM ssh WHERE action = 'ssh_failed' ORDER BY ts DESC, id LIMIT 20""")
def _(t):
    return q.sample(t.ssh, 20, action="ssh_failed").select("id", "ts", "user", "src_ip", "action")


@query("a13_sample_by_dedup", "fw", """
SELECT dedup_key, id, src_ip, dst_ip FROM fw WHERE dedup_key IN (SELECT 'fw:' || p_partkey || ':1' FROM part)""")
def _(t):
    keys = t.raw("part").select(F.concat(F.lit("fw:"), F.col("p_partkey").cast("string"), F.lit(":1")).alias("dedup_key"))
    return q.sample_by_dedup(t.fw, keys, None).select("dedup_key", "id", "src_ip", "dst_ip")


@query("a14_dns_domain_stats", "dns", """
SELECT domain, count(*) AS total, count(*) FILTER (WHERE blocked) AS blocked_total FROM dns WHERE domain IS NOT NULL
GROUP BY domain ORDER BY total DESC, domain LIMIT 50""")
def _(t):
    return q.dns_domain_stats(t.dns, 50)


@query("a15_dns_client_stats", "dns", """
SELECT client_ip, count(*) AS total, count(*) FILTER (WHERE blocked) AS blocked_total FROM dns GROUP BY client_ip
ORDER BY total DESC, client_ip LIMIT 30""")
def _(t):
    return q.dns_client_stats(t.dns, 30)


@query("a16_dns_client_domain_stats", "dns", "SELECT client_ip, domain, count(*) AS queries FROM dns GROUP BY client_ip, domain")
def _(t):
    return q.dns_client_domain_stats(t.dns)


@query("a17_bytes_by_pair", "fw", """
SELECT src_ip, dst_ip, sum(pkt_len)::BIGINT AS bytes, count(*) AS hits FROM fw WHERE action = 'accept' GROUP BY src_ip, dst_ip
ORDER BY bytes DESC, src_ip, dst_ip LIMIT 500""")
def _(t):
    return q.bytes_by_pair(t.fw, 500, action="accept")


@query("a18_all_traffic_ips", "fw", "SELECT src_ip AS value FROM fw UNION SELECT dst_ip FROM fw")
def _(t):
    return q.all_traffic_ips(t.events)


@query("a18_all_dns_domains", "dns", "SELECT DISTINCT domain AS value FROM dns")
def _(t):
    return q.all_dns_domains(t.events)


@query("a19_traffic_involving", "fw", """
WITH ips AS (SELECT DISTINCT '203.0.113.' || s_suppkey AS ip FROM supplier)
SELECT src_ip, dst_ip, dst_port::BIGINT AS dst_port, proto, action, count(*) AS hits, min(ts) AS first_ts, max(ts) AS last_ts
FROM fw WHERE src_ip IN (SELECT ip FROM ips) OR dst_ip IN (SELECT ip FROM ips) GROUP BY src_ip, dst_ip, dst_port, proto, action""")
def _(t):
    ips = t.raw("supplier").select(F.concat(F.lit("203.0.113."), F.col("s_suppkey").cast("string")).alias("value"))
    return q.traffic_involving(t.fw, ips)


@query("a20_lookups_of", "dns", """
SELECT client_ip, domain, count(*) AS queries, count(*) FILTER (WHERE blocked) AS blocked, min(ts) AS first_ts, max(ts) AS last_ts
FROM dns WHERE domain IN (SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) FROM pages WHERE url LIKE 'https%') GROUP BY client_ip, domain""")
def _(t):
    host = F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
    wanted = t.raw("pages").where(F.col("url").startswith("https")).select(host.alias("value"))
    return q.lookups_of(t.dns, wanted)


_HOURS = "(epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0"


@query("a21_source_profile", "fw", f"""
SELECT src_ip, count(*) AS hits, count(DISTINCT dst_port) AS distinct_dst_ports, count(DISTINCT src_port) AS distinct_src_ports,
  min(ts) AS first_seen, max(ts) AS last_seen, min(ttl)::BIGINT AS ttl_min, max(ttl)::BIGINT AS ttl_max, round({_HOURS}, 2) AS duration_hours
FROM fw WHERE action = 'drop' GROUP BY src_ip ORDER BY hits DESC, src_ip LIMIT 40""")
def _(t):
    return q.source_profile(t.fw, 40, action="drop")


@query("a22_low_ttl_pairs", "fw", """
SELECT src_ip, dst_ip, proto, ttl::BIGINT AS ttl, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts
FROM fw WHERE ttl <= 3 GROUP BY src_ip, dst_ip, proto, ttl""")
def _(t):
    return q.low_ttl_pairs(t.fw, 3)


@query("a23_ports_by_source", "fw", """
SELECT src_ip, dst_port::BIGINT AS dst_port, n, rank FROM (SELECT src_ip, dst_port, count(*) AS n,
  row_number() OVER (PARTITION BY src_ip ORDER BY count(*) DESC, dst_port) AS rank FROM fw GROUP BY src_ip, dst_port) WHERE rank <= 6""")
def _(t):
    return q.ports_by_source(t.fw, 6)


@query("a24_subnet_spread", "fw", """
SELECT regexp_extract(src_ip, '^(\\d+\\.\\d+\\.\\d+)', 1) || '.0/24' AS prefix, count(DISTINCT src_ip) AS sources, count(*) AS hits
FROM fw WHERE action = 'drop' GROUP BY 1 ORDER BY sources DESC, hits DESC, prefix LIMIT 10""")
def _(t):
    return q.subnet_spread(t.fw, 10, action="drop")


@query("a25_return_traffic_count", "fw", "SELECT count(*) AS n FROM fw WHERE action = 'drop' AND proto = 'tcp' AND src_port IN (80, 443)")
def _(t):
    return q.return_traffic_count(t.fw, action="drop")


@query("r03_get_events", "fw", """
SELECT id, ts, src_ip, dst_ip, action FROM fw WHERE src_ip = '10.10.0.21' AND action = 'drop' ORDER BY ts DESC, id, dedup_key LIMIT 50""")
def _(t):
    return q.get_events(t.events, 50, src_ip="10.10.0.21", action="drop", domain="", kind="any").select(
        "id", "ts", "src_ip", "dst_ip", "action"
    )
