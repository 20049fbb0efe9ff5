"""Registered queries: cloud activity, history, quality, review, reporting, sources and streams."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from sentrylake.functions import scalars
from sentrylake.operators import cloud, quality, reporting, review
from sentrylake.operators import history as H
from sentrylake.operators import query as q
from sentrylake.plans.detections import IP_MATCHES, NAME_MATCHES, bare, values
from sentrylake.plans.registry import query
from sentrylake.plans.tables import AS_OF
from sentrylake.session import scratch_path
from sentrylake.sources.entities import EntityStore
from sentrylake.sources.snapshots import AnswerCache, Suppressions, Watchlist

# ----- cloud


def _evidence(where: str, key: str, name: str = "k", view: str = "cloud") -> str:
    """SQL of the shared evidence of a group: e (counts) and the ten first values of each list."""

    def pick(alias: str, expr: str, n: int = 10) -> str:
        return (
            f"(SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT {expr} AS v FROM rows x WHERE x.{name} = g.{name} "
            f"AND coalesce({expr}, '') <> '' ORDER BY v LIMIT {n}) z) AS {alias}"
        )

    return f"""rows AS (SELECT *, {key} AS {name} FROM {view} WHERE {where}),
g AS (SELECT {name}, count(*) AS events, min(ts) AS first_seen, max(ts) AS last_seen, count(*) FILTER (WHERE action = 'ok') AS succeeded,
  bool_or(action = 'ok') AS any_ok, count(DISTINCT program) AS api_count FROM rows GROUP BY {name}),
e AS (SELECT g.*, {pick('apis', 'program')}, {pick('principals', '"user"')}, {pick('source_ips', 'src_ip')}, {pick('accounts_regions', 'device')},
  {pick('user_agents', 'user_agent', 5)}, {pick('error_codes', 'error_code')} FROM g)"""


_SHARED = """events, first_seen, last_seen, apis, principals, coalesce(source_ips, '') AS source_ips, accounts_regions, user_agents, coalesce(error_codes, '') AS error_codes"""


def _signal(signal_id: str, severity: str, confidence: str, extra: str = "", where: str = "true") -> str:
    more = f", {extra}" if extra else ""
    return f"SELECT {signal_id} AS signal_id, ({severity})::BIGINT AS severity_hint, {confidence}::DOUBLE AS confidence, {_SHARED}{more} FROM e WHERE {where}"


def _c(signals):
    return bare(signals).drop("entities")


_IN = lambda values: ", ".join(f"'{v}'" for v in values)
_LIKE = lambda values: "(" + " OR ".join(f"lower(program) LIKE '{v.lower()}%'" for v in values) + ")"


@query("l01_audit_metrics", "cloud", """SELECT 'aws.ct.events' AS key, count(*)::DOUBLE AS value_num FROM cloud UNION ALL SELECT 'aws.ct.writes', count(*) FROM cloud WHERE severity = 'write'
  UNION ALL SELECT 'aws.ct.denied', count(*) FROM cloud WHERE action = 'denied' UNION ALL SELECT 'aws.ct.principals', count(DISTINCT "user") FROM cloud""")
def _(t):
    return values(cloud.audit_metrics(t.cloud))


@query("l02_root_usage", "cloud", "WITH " + _evidence("\"user\" LIKE '%:root'", "account", "account")
       + _signal("'aws.root_activity.' || account", "3", "0.8", "account"))
def _(t):
    return _c(cloud.root_usage(t.cloud))


@query("l03_console_login_no_mfa", "cloud", "WITH " + _evidence("action = 'aws_login_ok' AND principal_type IN ('IAMUser', 'Root') AND mfa = 'No'", '"user"')
       + _signal("'aws.console_login_no_mfa.' || k", "2", "0.7", 'k AS "user"'))
def _(t):
    return _c(cloud.console_login_no_mfa(t.cloud))


@query("l04_console_login_failures", "cloud", "WITH " + _evidence("action = 'aws_login_fail'", 'coalesce(src_ip, "user")')
       + _signal("'aws.console_login_failures.' || k", "2", "0.6", "k AS who", "events >= 5"))
def _(t):
    return _c(cloud.console_login_failures(t.cloud))


@query("l05_logging_tampering", "cloud", "WITH " + _evidence(f"program IN ({_IN(cloud.TAMPERING)})", "program || '.' || \"user\"")
       + _signal("'aws.defense_evasion.' || k", "CASE WHEN any_ok THEN 3 ELSE 2 END", "0.75", "any_ok"))
def _(t):
    return _c(cloud.logging_tampering(t.cloud)).drop("program", "user")


_TARGETS = """coalesce((SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT unnest(targets) AS v FROM rows x WHERE x.k = e.k ORDER BY v LIMIT 20) z), '') AS targets"""


def _change(where: str, label: str, extra: str = "") -> str:
    return "WITH " + _evidence(where, '"user"') + _signal(
        f"'aws.{label}.' || k", "CASE WHEN any_ok THEN 2 ELSE 1 END", "0.6", f'k AS "user", succeeded, {_TARGETS}{extra}'
    )


@query("l06_iam_persistence", "cloud", _change(f"program IN ({_IN(cloud.IAM_CHANGES)})", "iam_change"))
def _(t):
    return _c(cloud.iam_persistence(t.cloud))


@query("l07_storage_change", "cloud", _change(f"program IN ({_IN(cloud.STORAGE_CHANGES)})", "storage_change"))
def _(t):
    return _c(cloud.storage_change(t.cloud))


@query("l08_compute_launch", "cloud", _change(_LIKE(cloud.COMPUTE_PREFIXES), "compute_launch"))
def _(t):
    return _c(cloud.compute_launch(t.cloud))


_REQUESTS = """(SELECT string_agg(request, ',' ORDER BY ts, id) FROM (SELECT request, ts, id FROM rows x WHERE x.k = e.k ORDER BY ts, id LIMIT 5) z) AS requests"""


@query("l09_dns_edge_change", "cloud", _change(_LIKE(cloud.DNS_EDGE_PREFIXES), "dns_edge_change", f", {_REQUESTS}"))
def _(t):
    return _c(cloud.dns_edge_change(t.cloud))


@query("l10_cross_account", "cloud", "WITH " + _evidence("principal_type = 'AWSAccount' AND caller_account <> account", "caller_account")
       + _signal("'aws.cross_account.' || k", "1", "0.6", "k AS caller_account"))
def _(t):
    return _c(cloud.cross_account(t.cloud))


@query("l11_permission_probing", "cloud", "WITH " + _evidence("action = 'denied'", '"user"') + _signal(
    "'aws.permission_probing.' || k", "2", "0.6", """k AS "user", api_count AS denied_api_count,
  (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT program AS v FROM rows x WHERE x.k = e.k ORDER BY v LIMIT 20) z) AS denied_apis""", "events >= 10 AND api_count >= 5"))
def _(t):
    return _c(cloud.permission_probing(t.cloud))


def _sweep(where: str, touched: str, label: str, severity: int, minimum: int) -> str:
    rated = f"CASE WHEN all_console THEN 1 ELSE {severity} END" if severity < 3 else str(severity)
    return f"""WITH rows0 AS (SELECT *, {touched} AS touched FROM cloud WHERE action = 'ok' AND {where}),
breadth AS (SELECT "user", count(DISTINCT v) AS distinct_count FROM (SELECT "user", unnest(touched) AS v FROM rows0) GROUP BY 1),
console AS (SELECT "user", bool_and(from_console) AS all_console FROM rows0 GROUP BY 1),
kept AS (SELECT rows0.*, distinct_count, all_console FROM rows0 JOIN breadth USING ("user") JOIN console USING ("user") WHERE distinct_count >= {minimum}),
""" + _evidence("true", '"user"', view="kept") + f""" SELECT 'aws.{label}_sweep.' || k AS signal_id, ({rated})::BIGINT AS severity_hint, 0.6::DOUBLE AS confidence, {_SHARED}, k AS "user", distinct_count,
  (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT unnest(touched) AS v FROM rows x WHERE x.k = e.k ORDER BY v LIMIT 20) z) AS "distinct", all_console AS all_from_console
  FROM e JOIN (SELECT DISTINCT "user", distinct_count, all_console FROM kept) s ON s."user" = e.k"""


@query("l12_secrets_sweep", "cloud", _sweep(f"program IN ({_IN(cloud.SECRET_READS)})", "targets", "secrets", 3, 5))
def _(t):
    return _c(cloud.secrets_sweep(t.cloud, minimum=5))


@query("l13_iam_enumeration", "cloud", _sweep(_LIKE(cloud.IAM_READ_PREFIXES), "[program]", "iam_enum", 2, 3))
def _(t):
    return _c(cloud.iam_enumeration(t.cloud, minimum=3))


@query("l14_bucket_sweep", "cloud", _sweep(_LIKE(cloud.BUCKET_PREFIXES), "list_filter(targets, lambda x: x NOT LIKE '%/%')", "buckets", 2, 8))
def _(t):
    return _c(cloud.bucket_sweep(t.cloud, minimum=8))


@query("l15_unexpected_region", "cloud", "WITH " + _evidence(
    f"severity = 'write' AND region NOT IN ('us-east-1', 'eu-west-1', 'us-west-2') AND split_part(program, ':', 1) NOT IN ({_IN(cloud.GLOBAL_SERVICES)})", "region", "region")
       + _signal("'aws.unexpected_region.' || region", "2", "0.65", "region"))
def _(t):
    return _c(cloud.unexpected_region(t.cloud, t.profile))


# Two accounts with rules of the same names: a group is an account and a rule.
_ONE, _TWO = "device LIKE '100000000001/%'", "device LIKE '100000000002/%'"
_OF_RULE = "split_part(rule, '|', 1) AS account_id, split_part(rule, '|', 2) AS rule"


def _ruled(where: str, rule: str) -> str:
    return "WITH " + _evidence(where, f"split_part(device, '/', 1) || '|' || {rule}", "rule")


def _of_rule(signal_id: str, severity: str, confidence: str, extra: str = "") -> str:
    return _signal(f"'{signal_id}.' || split_part(rule, '|', 2)", severity, confidence, _OF_RULE + extra)


def _rule_list(value: str, name: str) -> str:
    return f", (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT {value} AS v FROM rows x WHERE x.rule = e.rule ORDER BY v LIMIT 20) z) AS {name}"


@query("l16_dormant_principal", "cloud", _ruled(f"({_ONE} OR {_TWO}) AND lower(\"user\") LIKE '%user/u3'", "'user/u3'") + _of_rule("aws.dormant_principal", "3", "0.85"))
def _(t):
    return _c(cloud.dormant_principal(t.cloud, t.profile))


@query("l16_unexpected_access_key", "cloud", _ruled(f"((({_ONE} OR {_TWO}) AND \"user\" LIKE '%user/u3') OR ({_TWO} AND \"user\" LIKE '%user/u8')) AND access_key_id LIKE 'AKIA%'",
    "CASE WHEN \"user\" LIKE '%user/u3' THEN 'user/u3' ELSE 'user/u8' END") + _of_rule("aws.long_term_key_use", "3", "0.8", _rule_list("access_key_id", "access_keys")))
def _(t):
    return _c(cloud.unexpected_access_key(t.cloud, t.profile))


@query("l17_out_of_scope_service", "cloud", _ruled(f"\"user\" LIKE '%role/r2' AND (({_ONE} AND split_part(program, ':', 1) NOT IN ('s3', 'sts')) OR ({_TWO} AND split_part(program, ':', 1) NOT IN ('iam', 'sts')))", "'role/r2'")
       + _of_rule("aws.out_of_scope_service", "3", "0.8"))
def _(t):
    return _c(cloud.out_of_scope_service(t.cloud, t.profile))


_STRAY = f"""program LIKE 's3:%' AND (({_ONE} AND "user" LIKE '%role/r2' AND NOT targets[1] IN ('res1', 'res2'))
  OR ({_TWO} AND "user" LIKE '%user/u8' AND targets[1] <> 'res5') OR ({_TWO} AND "user" LIKE '%role/r2' AND targets[1] <> 'res3'))"""


@query("l17_out_of_scope_bucket", "cloud", _ruled(_STRAY, "CASE WHEN \"user\" LIKE '%role/r2' THEN 'role/r2' ELSE 'user/u8' END")
       + _of_rule("aws.out_of_scope_bucket", "3", "0.8", _rule_list("unnest(targets)", "buckets")))
def _(t):
    return _c(cloud.out_of_scope_bucket(t.cloud, t.profile))


@query("l18_blocked_account", "cloud", _ruled(f"({_ONE} OR {_TWO}) AND (raw_json LIKE '%zone-77%' OR \"user\" LIKE '%zone-77%')", "'zone-77'") + _of_rule("aws.blocked_account", "3", "0.85"))
def _(t):
    return _c(cloud.blocked_account(t.cloud, t.profile))


@query("l18_watched_resource", "cloud", _ruled(f"(({_ONE} OR {_TWO}) AND raw_json LIKE '%zone-123%') OR ({_TWO} AND raw_json LIKE '%zone-45%')", "CASE WHEN raw_json LIKE '%zone-123%' THEN 'zone-123' ELSE 'zone-45' END")
       + _of_rule("aws.watched_resource", "CASE rule WHEN '100000000001|zone-123' THEN 2 ELSE 3 END", "0.8", f", {_REQUESTS.replace('x.k = e.k', 'x.rule = e.rule')}"))
def _(t):
    return _c(cloud.watched_resource(t.cloud, t.profile))


@query("l19_cloud_finding", "gd", """WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY program ORDER BY score DESC, ts, id) AS r,
    CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END AS rank FROM gd),
  g AS (SELECT program, count(*) AS events, bool_and(sample) AS sample, max(rank) AS worst, max(CASE WHEN r = 1 THEN score END) AS max_score, max(CASE WHEN r = 1 THEN description END) AS description FROM ranked GROUP BY 1)
  SELECT 'aws.guardduty.' || program AS signal_id, CASE WHEN sample THEN 0 ELSE worst END::BIGINT AS severity_hint, CASE WHEN sample THEN 0.3 ELSE 0.85 END::DOUBLE AS confidence, events, program AS finding_type,
  round(max_score, 6) AS max_score, description, sample, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][worst] AS worst_severity,
  (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT coalesce(instance_id, resource_type) AS v FROM gd x WHERE x.program = g.program ORDER BY v LIMIT 10) z) AS resources FROM g""")
def _(t):
    return bare(cloud.cloud_finding(t.gd)).select(
        "signal_id", "severity_hint", "confidence", "events", "finding_type", "max_score", "description", "sample", "worst_severity", "resources"
    )


@query("l19_finding_count", "gd", "SELECT 'aws.gd.findings' AS key, count(*)::DOUBLE AS value_num FROM gd")
def _(t):
    return values(cloud.finding_count(t.gd))


@query("l20_cloud_evidence", "cloud", "WITH " + _evidence("true", "region", "region") + f"SELECT region, {_SHARED} FROM e")
def _(t):
    return cloud.cloud_evidence(t.cloud.withColumn("region", F.col("raw.region")), ["region"])


# ----- history

_ENTITIES = """pairs AS (SELECT 'domain' AS etype, lower(domain) AS value FROM dns UNION ALL SELECT 'ip', client_ip FROM dns UNION ALL SELECT 'ip', src_ip FROM fw
  UNION ALL SELECT 'ip', src_ip FROM ssh UNION ALL SELECT 'user', "user" FROM ssh UNION ALL SELECT 'device', "user" FROM wifi WHERE "user" IS NOT NULL)"""


def _entity_events(t):
    return t.dns.unionByName(t.fw).unionByName(t.ssh).unionByName(t.wifi)


@query("k07_entity_pairs", "dns fw ssh wifi", f"WITH {_ENTITIES} SELECT etype, value, count(*) AS n FROM pairs GROUP BY etype, value")
def _(t):
    return H.entity_pairs(_entity_events(t))


def _observed(t):
    first = H.observations(t.dns.unionByName(t.ssh), "run1", "2024-01-01 00:00:00")
    second = H.observations(t.fw.unionByName(t.dns), "run2", "2024-01-02 00:00:00", observe_dst=True)
    return first.unionByName(second)


_OBSERVED = """obs AS (SELECT 'domain' AS etype, domain AS value, 1 AS run FROM dns UNION ALL SELECT 'ip', client_ip, 1 FROM dns UNION ALL SELECT 'ip', src_ip, 1 FROM ssh UNION ALL SELECT 'user', "user", 1 FROM ssh
  UNION ALL SELECT 'ip', src_ip, 2 FROM fw UNION ALL SELECT 'domain', domain, 2 FROM dns UNION ALL SELECT 'ip', client_ip, 2 FROM dns UNION ALL SELECT DISTINCT 'dst_ip', dst_ip, 2 FROM fw),
known AS (SELECT etype, value, TIMESTAMP '2024-01-01 00:00:00' + (min(run) - 1) * INTERVAL 1 DAY AS first_seen, TIMESTAMP '2024-01-01 00:00:00' + (max(run) - 1) * INTERVAL 1 DAY AS last_seen,
  count(*) AS occurrences FROM obs GROUP BY etype, value)"""


@query("k06_observe_entities", "dns fw ssh", f"WITH {_OBSERVED} SELECT * FROM known")
def _(t):
    """Two runs observed, the first one twice, and merged between them."""
    store = EntityStore(t.spark, scratch_path(t.spark, "baseline"))
    first = H.observations(t.dns.unionByName(t.ssh), "run1", "2024-01-01 00:00:00")
    store.observe("run1", first.where("etype = 'ip'"))
    store.observe("run1", first)
    store.compact()
    store.observe("run2", H.observations(t.fw.unionByName(t.dns), "run2", "2024-01-02 00:00:00", observe_dst=True))
    return store.known()


@query("h02_entity_first_seen", "dns fw ssh", f"WITH {_OBSERVED} SELECT DISTINCT k.value, k.first_seen FROM known k JOIN dns ON k.value = client_ip WHERE etype = 'ip'")
def _(t):
    return H.entity_first_seen(H.entities(_observed(t)), "ip", q.distinct_values(t.dns, "client_ip"))


@query("h03_entity_info", "dns fw ssh", f"WITH {_OBSERVED} SELECT * FROM known WHERE value = '10.10.0.22' ORDER BY etype LIMIT 1")
def _(t):
    return H.entity_info(H.entities(_observed(t)), "10.10.0.22")


@query("h04_finding_recurrence", "findings", f"""SELECT v AS value, count(DISTINCT run_id) AS prior_runs FROM (SELECT run_id, unnest(named) AS v FROM findings WHERE taxonomy = 'c2.beacon_candidate'
  AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) GROUP BY v""")
def _(t):
    return H.finding_recurrence(t.findings, "c2.beacon_candidate", AS_OF)


@query("h04_taxonomy_recurrence", "findings", f"SELECT taxonomy, count(DISTINCT run_id) AS prior_runs FROM findings WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY taxonomy")
def _(t):
    return H.taxonomy_recurrence(t.findings, AS_OF)


@query("h05_prior_findings_for", "findings", f"""SELECT ts, title, severity::BIGINT AS severity, taxonomy, run_id FROM findings WHERE list_contains(named, '10.10.0.33') AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY""")
def _(t):
    return H.prior_findings_for(t.findings, "10.10.0.33", AS_OF)


@query("r04_entity_history", "dns fw ssh findings", f"""WITH {_OBSERVED} SELECT '10.10.0.33' AS entity, first_seen, occurrences, (SELECT count(*) FROM (SELECT 1 FROM findings WHERE list_contains(named, '10.10.0.33')
  AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY)) AS past FROM known WHERE etype = 'ip' AND value = '10.10.0.33'""")
def _(t):
    h = H.entity_history(H.entities(_observed(t)), t.findings, "10.10.0.33", AS_OF)
    return h.select("entity", F.col("baseline.first_seen").alias("first_seen"), F.col("baseline.occurrences").alias("occurrences"),
                    F.size("prior_findings").cast("bigint").alias("past"))


_SLICES = """ioc_dns AS (SELECT date_trunc('day', ts)::DATE AS day, client_ip, domain, count(*) AS queries, count(*) FILTER (WHERE blocked) AS blocked FROM dns GROUP BY 1, 2, 3),
ioc_flow AS (SELECT DATE '2024-01-10' AS day, src_ip, dst_ip, dst_port, proto, count(*) AS hits FROM fw WHERE NOT starts_with(dst_ip, '10.') GROUP BY 2, 3, 4, 5)"""


def _ioc_dns(t):
    per_day = t.dns.groupBy(F.to_date("ts").alias("day"), "client_ip", "domain").agg(
        F.count("*").alias("queries"), F.count_if("blocked").alias("blocked")
    )
    return per_day.withColumn("run_id", F.lit("run1"))


def _ioc_flow(t):
    return H.build_ioc_flow(t.fw, t.profile, "run1", "2024-01-10")


@query("k04_build_ioc_dns", "dns", "SELECT 'run1' AS run_id, '2024-01-31' AS day, client_ip, domain, count(*) AS queries, count(*) FILTER (WHERE blocked) AS blocked FROM dns GROUP BY client_ip, domain")
def _(t):
    return H.build_ioc_dns(t.events, "run1", "2024-01-31")


@query("k05_build_ioc_flow", "fw", """SELECT 'run1' AS run_id, '2024-01-10' AS day, src_ip, dst_ip, dst_port::BIGINT AS dst_port, proto, count(*) AS hits FROM fw WHERE NOT starts_with(dst_ip, '10.')
  GROUP BY src_ip, dst_ip, dst_port, proto""")
def _(t):
    return _ioc_flow(t)


@query("h06_hunt_domain", "dns fw", f"""WITH {_SLICES} SELECT CAST(day AS VARCHAR) AS day, client_ip, domain, queries, blocked FROM ioc_dns WHERE day >= DATE '2024-01-15' AND domain ILIKE '%THE%'""")
def _(t):
    return H.hunt_domain(_ioc_dns(t), "THE", "2024-01-30 00:00:00", 15)


@query("h07_hunt_ip", "dns fw", f"""WITH {_SLICES} SELECT CAST(day AS VARCHAR) AS day, src_ip, dst_ip, dst_port::BIGINT AS dst_port, proto, hits FROM ioc_flow WHERE src_ip = '203.0.113.10' OR dst_ip = '203.0.113.10'""")
def _(t):
    return H.hunt_ip(_ioc_flow(t), "203.0.113.10", "2024-01-30 00:00:00")


@query("h08_history_values", "dns fw", f"WITH {_SLICES} SELECT src_ip AS value FROM ioc_flow UNION SELECT dst_ip FROM ioc_flow UNION SELECT domain FROM ioc_dns WHERE day >= DATE '2024-01-15'")
def _(t):
    return H.history_ips(_ioc_flow(t), "2024-01-30 00:00:00", 15 + 365).unionByName(H.history_domains(_ioc_dns(t), "2024-01-30 00:00:00", 15))


@query("h09_flow_history_for", "dns fw", f"""WITH {_SLICES}, two AS (SELECT * FROM ioc_flow UNION ALL SELECT * FROM ioc_flow) SELECT CAST(day AS VARCHAR) AS day, src_ip, dst_ip, dst_port::BIGINT AS dst_port, proto, sum(hits)::BIGINT AS hits FROM two
  WHERE src_ip IN (SELECT '203.0.113.' || s_suppkey FROM supplier) OR dst_ip IN (SELECT '203.0.113.' || s_suppkey FROM supplier) GROUP BY day, src_ip, dst_ip, dst_port, proto""")
def _(t):
    twice = _ioc_flow(t).unionByName(_ioc_flow(t).withColumn("run_id", F.lit("run2")))
    ips = t.raw("supplier").select(F.concat(F.lit("203.0.113."), F.col("s_suppkey").cast("string")).alias("value"))
    return H.flow_history_for(twice, ips, "2024-01-30 00:00:00")


@query("h09_dns_history_for", "dns fw", f"""WITH {_SLICES} SELECT CAST(day AS VARCHAR) AS day, client_ip, domain, queries::BIGINT AS queries, blocked::BIGINT AS blocked FROM ioc_dns WHERE domain LIKE '%.com'""")
def _(t):
    wanted = q.distinct_values(t.dns, "domain").where(F.col("value").endswith(".com"))
    return H.dns_history_for(_ioc_dns(t), wanted, "2024-01-30 00:00:00")


@query("h10_retro_hunt", "dns fw iocs", f"""WITH {_SLICES}, {IP_MATCHES.replace('SELECT DISTINCT src_ip AS value FROM fw UNION SELECT DISTINCT dst_ip FROM fw', 'SELECT DISTINCT src_ip AS value FROM ioc_flow UNION SELECT DISTINCT dst_ip FROM ioc_flow')},
  {NAME_MATCHES}, worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY value ORDER BY severity DESC, indicator DESC) AS r FROM (SELECT * FROM ip_hits UNION ALL SELECT * FROM name_hits)) WHERE r = 1)
  SELECT w.value, w.indicator, w.tier, w.severity::BIGINT AS severity, CAST(f.day AS VARCHAR) AS day, sum(f.hits)::BIGINT AS hits, NULL::BIGINT AS blocked FROM ioc_flow f JOIN worst w ON w.value IN (f.src_ip, f.dst_ip) GROUP BY 1, 2, 3, 4, 5
  UNION ALL SELECT w.value, w.indicator, w.tier, w.severity::BIGINT, CAST(d.day AS VARCHAR), sum(d.queries)::BIGINT, sum(d.blocked)::BIGINT FROM ioc_dns d JOIN worst w ON w.value = d.domain GROUP BY 1, 2, 3, 4, 5""")
def _(t):
    return H.retro_hunt(_ioc_flow(t), _ioc_dns(t), t.indicators, "2024-01-30 00:00:00")


@query("h11_active_watchlist", "watchlist", f"""WITH upd AS (SELECT 'ip' AS entity_type, '10.10.0.' || n_nationkey AS entity_value, n_name AS reason, n_nationkey - 3 AS days FROM nation), fresh AS (
    SELECT entity_type, entity_value, reason, TIMESTAMP '{AS_OF}' + greatest(1, days) * INTERVAL 1 DAY AS expires_at FROM upd),
  merged AS (SELECT entity_type, entity_value, reason, expires_at FROM watchlist w WHERE NOT EXISTS (SELECT 1 FROM upd u WHERE u.entity_type = w.entity_type AND u.entity_value = w.entity_value) UNION ALL SELECT * FROM fresh)
  SELECT * FROM merged WHERE (expires_at IS NULL OR expires_at >= TIMESTAMP '{AS_OF}') AND NOT (entity_type = 'domain')""")
def _(t):
    updates = t.raw("nation").select(
        F.lit("ip").alias("entity_type"), F.concat(F.lit("10.10.0."), F.col("n_nationkey").cast("string")).alias("entity_value"),
        F.col("n_name").alias("reason"), (F.col("n_nationkey") - 3).alias("expires_days"),
    )
    watch = Watchlist(t.spark, scratch_path(t.spark, "watch"))
    watch.update(lambda none: none.unionByName(t.watchlist, allowMissingColumns=True))
    watch.add(updates, AS_OF)
    watch.remove(watch.read().where(F.col("entity_type") == "domain").select("entity_type", "entity_value").distinct())
    return watch.active(AS_OF).drop("created_at")


_SUPPRESSIONS = """supp AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN ['scan.persistent_prober', 'c2.beacon_candidate'][s_suppkey % 2 + 1] END AS taxonomy,
  CASE WHEN s_suppkey % 4 = 1 THEN '10.10.0.' || (s_suppkey % 50 + 20) END AS entity, CASE WHEN s_suppkey % 10 = 2 THEN 'urgent' END AS title_contains,
  CASE WHEN s_suppkey % 2 = 0 THEN 'LOW' WHEN s_suppkey % 5 = 0 THEN 'HIGH' END AS max_severity, 'because ' || s_name AS reason FROM supplier)"""


def _suppressions(t):
    s = F.col("s_suppkey")
    return t.raw("supplier").select(
        s.alias("id"),
        F.when(s % 3 == 0, F.when(s % 2 == 0, "scan.persistent_prober").otherwise("c2.beacon_candidate")).alias("taxonomy"),
        F.when(s % 4 == 1, F.concat(F.lit("10.10.0."), (s % 50 + 20).cast("string"))).alias("entity"),
        F.when(s % 10 == 2, "urgent").alias("title_contains"),
        F.when(s % 2 == 0, "LOW").when(s % 5 == 0, "HIGH").alias("max_severity"),
        F.concat(F.lit("because "), "s_name").alias("reason"),
        F.when(s % 6 > 0, F.timestamp_add("DAY", s.cast("int"), F.lit("1998-05-01 00:00:00").cast("timestamp"))).alias("expires_at"),
        F.lit(0).alias("hits"),
    )


@query("h12_active_suppressions", "", f"""WITH rules AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 > 0 THEN 't' || s_suppkey END AS taxonomy, CASE WHEN s_suppkey % 3 < 2 THEN 'e' || s_suppkey END AS entity,
    CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey - 3 END AS days, s_name AS reason FROM supplier),
  numbered AS (SELECT row_number() OVER (ORDER BY taxonomy NULLS FIRST, entity NULLS FIRST) AS id, * FROM rules)
  SELECT id, taxonomy, entity, reason, (SELECT count(*) FROM orders WHERE o_custkey = id) AS hits FROM numbered
  WHERE id % 7 > 0 AND (days IS NULL OR TIMESTAMP '1998-05-01 00:00:00' + greatest(1, days) * INTERVAL 1 DAY >= TIMESTAMP '{AS_OF}')""")
def _(t):
    """Rules added, counted up, deleted and expired, each a version of the stored table."""
    s = F.col("s_suppkey")
    rules = t.raw("supplier").select(
        F.when(s % 3 > 0, F.concat(F.lit("t"), s.cast("string"))).alias("taxonomy"), F.when(s % 3 < 2, F.concat(F.lit("e"), s.cast("string"))).alias("entity"),
        F.lit(None).cast("string").alias("title_contains"), F.lit(None).cast("string").alias("max_severity"), F.col("s_name").alias("reason"),
        F.when(s % 5 > 0, s - 3).cast("int").alias("expires_days"),
    )
    stored = Suppressions(t.spark, scratch_path(t.spark, "suppressions"))
    stored.add(rules, "1998-05-01 00:00:00")
    stored.bump(t.raw("orders").select(F.col("o_custkey").alias("id")))
    stored.delete(stored.read().where("id % 7 = 0"))
    return stored.active(AS_OF).select("id", "taxonomy", "entity", "reason", "hits")


def _cache(t):
    k = F.col("o_custkey")
    return t.raw("orders").select(
        F.when(k % 2 == 0, "ip-rep").otherwise("name-rep").alias("enricher"),
        F.concat(F.lit("203.0.113."), (k % 60).cast("string")).alias("subject"),
        F.timestamp_add("SECOND", (F.col("o_orderkey") % 50000).cast("int"), F.col("o_orderdate").cast("timestamp")).alias("fetched_at"),
        F.timestamp_add("DAY", (k % 40).cast("int"), F.col("o_orderdate").cast("timestamp")).alias("expires_at"),
        F.element_at(F.array(*[F.lit(v) for v in ("benign", "unknown", "malicious")]), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("verdict"),
    )


_CACHE = """cache AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN 'ip-rep' ELSE 'name-rep' END AS enricher, '203.0.113.' || (o_custkey % 60) AS subject,
  o_orderdate + (o_orderkey % 50000) * INTERVAL 1 SECOND AS fetched_at, o_orderdate + (o_custkey % 40) * INTERVAL 1 DAY AS expires_at, ['benign', 'unknown', 'malicious'][o_orderkey % 3 + 1] AS verdict FROM orders),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY enricher, subject ORDER BY fetched_at DESC) AS r FROM cache) WHERE r = 1)"""


@query("h13_cache_latest", "", f"WITH {_CACHE} SELECT enricher, subject, fetched_at, expires_at, verdict FROM newest WHERE expires_at >= TIMESTAMP '1998-08-05 00:00:00'")
def _(t):
    """Answers put in two batches, the later ones first."""
    answers = _cache(t)
    recent = F.col("fetched_at") >= F.lit("1996-01-01").cast("timestamp")
    cache = AnswerCache(t.spark, scratch_path(t.spark, "answers"))
    cache.put(answers.where(recent))
    cache.put(answers.where(~recent))
    return cache.get("1998-08-05 00:00:00").drop("body")


@query("j09_reputation_join", "", f"""WITH {_CACHE}, subj AS (SELECT enricher, subject, min(ord) AS ord FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'ip-rep' ELSE 'name-rep' END AS enricher,
    CASE p_partkey % 3 WHEN 0 THEN '8.8.' || (p_partkey % 90) || '.1' WHEN 1 THEN '10.0.0.' || (p_partkey % 100) ELSE '9.9.9.' || (p_partkey % 60) END AS subject, p_size AS ord FROM part) GROUP BY 1, 2),
  c AS (SELECT enricher, replace(subject, '203.0.113.', '9.9.9.') AS subject, verdict FROM newest WHERE expires_at >= TIMESTAMP '1998-08-05 00:00:00'),
  k AS (SELECT s.*, verdict, NOT starts_with(s.subject, '10.') AS useful FROM subj s LEFT JOIN c USING (enricher, subject)),
  r AS (SELECT *, row_number() OVER (PARTITION BY enricher, useful, verdict IS NULL ORDER BY ord, subject) AS r FROM k)
  SELECT enricher, 'ip' AS subject_type, subject, CASE WHEN NOT useful THEN 'prefiltered' WHEN verdict IS NOT NULL THEN 'cached' WHEN r <= 15 THEN 'pending' ELSE 'refused' END AS state, CASE WHEN useful THEN verdict END AS verdict FROM r""")
def _(t):
    k = F.col("p_partkey")
    text = lambda c: c.cast("string")
    subjects = t.raw("part").select(
        F.when(k % 2 == 0, "ip-rep").otherwise("name-rep").alias("enricher"), F.lit("ip").alias("subject_type"),
        F.when(k % 3 == 0, F.concat(F.lit("8.8."), text(k % 90), F.lit(".1"))).when(k % 3 == 1, F.concat(F.lit("10.0.0."), text(k % 100)))
        .otherwise(F.concat(F.lit("9.9.9."), text(k % 60))).alias("subject"), F.col("p_size").alias("ord"),
    )
    cache = _cache(t).withColumn("subject", F.replace("subject", F.lit("203.0.113."), F.lit("9.9.9.")))
    return reporting.reputation_join(subjects, cache, t.profile, "1998-08-05 00:00:00", budget=15)


# ----- quality

_STATS = """stats AS (SELECT source, count(*) AS records, count(DISTINCT dedup_key) AS unique_records, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0 AS span_hours FROM (
  SELECT source, dedup_key, ts FROM fw UNION ALL SELECT 'resolver2', dedup_key, ts FROM dns UNION ALL SELECT 'resolver2', dedup_key, ts FROM dns WHERE blocked UNION ALL SELECT source, dedup_key, ts FROM cloud) GROUP BY source)"""


def _collected(t):
    dns = t.dns.withColumn("source", F.lit("resolver2"))
    return t.fw.unionByName(dns).unionByName(q.where(dns, blocked=True)).unionByName(t.cloud)


@query("q01_collection_stats", "fw dns cloud", f"WITH {_STATS} SELECT source, records, unique_records, round(span_hours, 6) AS span_hours FROM stats")
def _(t):
    return quality.collection_stats(_collected(t))


def _manifest(t):
    """Manifests of one source per supplier: the first three have events, the others none."""
    s = F.col("s_suppkey")
    ts = lambda text: F.lit(text).cast("timestamp")
    probe = lambda ok, status, n: F.struct(F.lit("probe").alias("name"), ok.alias("ok"), status.cast("int").alias("status"), n.cast("bigint").alias("records"))
    return t.raw("supplier").select(
        F.when(s == 1, "syslog").when(s == 2, "resolver2").when(s == 3, "aws_cloudtrail").otherwise(F.concat(F.lit("s"), s.cast("string"))).alias("source"),
        ts("1995-01-01 00:00:00").alias("requested_start"), ts("2002-01-01 00:00:00").alias("requested_end"),
        F.when(s % 5 == 2, ts("2001-12-01 00:00:00")).otherwise(ts("1995-01-01 00:00:00")).alias("effective_start"),
        F.when(s == 3, 10).otherwise(None).cast("bigint").alias("reported_total"), F.lit(1).alias("pages"), (s % 7 > 0).alias("complete"),
        (s % 3 == 0).alias("activity_driven"), F.when(s == 3, 10**9).otherwise(0).cast("bigint").alias("min_expected"),
        F.when(s % 9 == 0, F.array(F.lit("timeout"))).otherwise(F.array().cast("array<string>")).alias("errors"),
        F.when(s % 4 == 0, F.array().cast(quality.MANIFEST_SCHEMA["probes"].dataType))
        .otherwise(F.array(probe(s % 2 == 0, F.when(s % 8 == 1, 401).otherwise(200), F.when(s % 10 == 6, 5).otherwise(0)))).alias("probes"),
    )


_HEALTH = f"""{_STATS}, man AS (SELECT s_suppkey AS s, CASE s_suppkey WHEN 1 THEN 'syslog' WHEN 2 THEN 'resolver2' WHEN 3 THEN 'aws_cloudtrail' ELSE 's' || s_suppkey END AS source, s_suppkey % 5 = 2 AS clamped,
    CASE WHEN s_suppkey % 5 = 2 THEN 744.0 ELSE 61368.0 END AS eff, s_suppkey % 7 > 0 AS complete, s_suppkey % 3 = 0 AS driven, s_suppkey % 9 = 0 AS err, s_suppkey % 4 <> 0 AS probed, s_suppkey % 2 = 0 AS ok, s_suppkey % 8 = 1 AS refused,
    s_suppkey % 10 = 6 AND s_suppkey % 4 <> 0 AS got FROM supplier),
  j AS (SELECT man.*, coalesce(records, 0) AS records, coalesce(unique_records, 0) AS uniq, coalesce(span_hours, 0) AS span FROM man LEFT JOIN stats USING (source)),
  health AS (SELECT source, records, uniq AS unique_records, CASE WHEN records = 0 THEN (CASE WHEN driven AND NOT err AND probed AND ok THEN 'OK' WHEN probed AND NOT (ok AND got) AND NOT refused AND NOT got THEN 'FAILED' ELSE 'SUSPECT' END)
    WHEN (s = 3 AND (10 - uniq) > 10 * 0.02) OR records <> uniq OR NOT complete OR (NOT driven AND span < eff * 0.85) OR (s = 3 AND records < 1000000000) OR clamped OR err THEN 'DEGRADED' ELSE 'OK' END AS state FROM j)"""


@query("q02_classify_health", "fw dns cloud", f"WITH {_HEALTH} SELECT source, records, unique_records, state, state IN ('OK', 'DEGRADED') AS usable FROM health")
def _(t):
    """Includes the probe rule (q03)."""
    health = quality.classify_health(quality.collection_stats(_collected(t)), _manifest(t))
    return health.select("source", "records", "unique_records", "state", "usable")


@query("q03_probes_prove_failure", "", """SELECT s_suppkey, s_suppkey % 4 <> 0 AND NOT (s_suppkey % 2 = 0 AND s_suppkey % 10 = 6) AND s_suppkey % 8 <> 1 AND NOT s_suppkey % 10 = 6 AS failed FROM supplier""")
def _(t):
    probes = _manifest(t).select("source", quality.probes_prove_failure(F.col("probes")).alias("failed"))
    number = (
        F.when(F.col("source") == "syslog", 1).when(F.col("source") == "resolver2", 2).when(F.col("source") == "aws_cloudtrail", 3)
        .otherwise(F.substring("source", 2, 20).try_cast("bigint"))
    )
    return probes.select(number.cast("bigint").alias("s_suppkey"), "failed")


@query("q04_dns_block_rate", "dns", "SELECT source, count(*) AS records, count(*) FILTER (WHERE blocked) AS blocked, round(100.0 * count(*) FILTER (WHERE blocked) / count(*), 6) AS block_rate_pct FROM dns GROUP BY source")
def _(t):
    return quality.dns_block_rate(t.dns)


@query("q04_emergency_breakdown", "wifi", "SELECT program, count(*) AS n FROM wifi WHERE severity = 'emerg' GROUP BY program ORDER BY n DESC, program LIMIT 5")
def _(t):
    return quality.emergency_breakdown(t.wifi)


@query("q05_device_records", "fw", """SELECT CAST(s_suppkey AS VARCHAR) AS device, s_suppkey * 10 AS reported, s_name AS hostname, coalesce(n, 0) AS records, n IS NULL AS zero_records, s_name AS label
  FROM supplier LEFT JOIN (SELECT device, count(*) AS n FROM fw GROUP BY device) ON device = CAST(s_suppkey AS VARCHAR)""")
def _(t):
    reported = t.raw("supplier").select(
        F.col("s_suppkey").cast("string").alias("device"), (F.col("s_suppkey") * 10).alias("reported"), F.col("s_name").alias("hostname")
    )
    return quality.device_records(t.fw, reported)


_CANARY_START, _CANARY_END = "2024-01-30 00:00:00", "2024-01-31 00:00:00"


def _canaries(t):
    day = lambda d: datetime(2024, 1, d, tzinfo=timezone.utc)
    return quality.canary_events(t.spark, day(30), day(31))


@query("y01_inject_canaries", "dns fw", """SELECT kind, source, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT kind, source, ts FROM dns UNION ALL SELECT kind, source, ts FROM fw
  UNION ALL SELECT 'dns', 'canary', TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 18300 SECOND + i * INTERVAL 300 SECOND FROM range(60) r(i)
  UNION ALL SELECT 'firewall', 'canary', TIMESTAMP '2024-01-30 18:00:00' + i * INTERVAL 54 SECOND FROM range(400) r(i)) GROUP BY kind, source""")
def _(t):
    rows = t.dns.unionByName(t.fw).unionByName(_canaries(t))
    return rows.groupBy("kind", "source").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("y02_verify_canaries", "dns fw", """WITH runs AS (SELECT 'planted' AS run, 0 AS every UNION ALL SELECT 'thinned', 1)
  SELECT run, canary, expect_taxonomy, CASE canary WHEN 'dns_beacon' THEN every = 0 ELSE true END AS detected, (SELECT count(*) FROM dns) + (SELECT count(*) FROM fw) AS beside
  FROM runs, (VALUES ('dns_beacon', 'c2.beacon_candidate'), ('persistent_prober', 'scan.persistent_prober')) v(canary, expect_taxonomy)""")
def _(t):
    """Planted among the given events, whole and with all but the first lookups of the beacon lost on the way."""
    from sentrylake.plans.daily import Context, run_canary_signals

    own = t.dns.unionByName(t.fw)
    beside, planted = own.agg(F.count("*")).first()[0], _canaries(t)
    thinned = planted.where("kind <> 'dns'").unionByName(planted.where("kind = 'dns'").orderBy("ts").limit(5))
    out = []
    for run, extra in (("planted", planted), ("thinned", thinned)):
        signals = run_canary_signals(Context(own.unionByName(extra), t.profile), ["dns_beacons", "persistent_prober"])
        out.append(quality.verify_canaries(signals).select(F.lit(run).alias("run"), "*", F.lit(beside).alias("beside")))
    return out[0].unionByName(out[1])


@query("y03_mark_canary_signals", "fw", """SELECT 'fw.stepped_ttl.' || src_ip AS signal_id, src_ip = '198.51.100.4' AS is_canary FROM (SELECT src_ip, count(*) AS n, min(ttl) AS lo, max(ttl) AS hi FROM fw
  WHERE action = 'drop' AND proto = 'udp' GROUP BY src_ip) WHERE lo <= 8 AND hi - lo >= 2 AND n >= 10""")
def _(t):
    from sentrylake.operators.perimeter import stepped_ttl

    return quality.mark_canary_signals(stepped_ttl(t.fw, min_spread=2), ("198.51.100.4",)).select("signal_id", "is_canary")


# ----- review

_SEV = "['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL', 'SUSPECTED', 'bogus']"


def _submitted(t):
    """Submitted findings from the orders table, citing signals from the customer table."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda x: x.cast("string")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    none = F.array().cast("array<string>")
    return t.raw("orders").select(
        k.alias("idx"), F.when(k % 50 == 0, " ").otherwise(F.concat(F.lit(" Finding "), "o_orderpriority")).alias("title"),
        pick(("info", "LOW", "Medium", "HIGH", "CRITICAL", "SUSPECTED", "bogus"), k % 7).alias("severity"),
        F.when(k % 3 == 0, "HIGH").when(k % 3 == 1, "sure").alias("confidence"), F.when(k % 4 == 0, "own.taxonomy").alias("taxonomy"),
        F.when(k % 2 == 0, "lan").alias("zone"),
        F.when(k % 6 == 5, none).otherwise(F.array(F.concat(F.lit("s"), text(c)), F.concat(F.lit("x"), text(k)), F.concat(F.lit("s"), text(c + 1)))).alias("signal_ids"),
        F.when(k % 5 == 0, none).otherwise(F.array(text(k), text(k + 10**12), F.lit("no number"), text(k))).alias("event_ids"),
        F.when(k % 8 == 0, none).when(k % 8 == 1, F.array(F.lit("reputation"))).when(k % 8 == 2, F.array(F.lit("reputation"), F.lit("baseline_delta")))
        .otherwise(F.array(F.lit("correlation"))).alias("evidence_kinds"),
        F.when(k % 9 == 0, F.array(*[F.struct(F.lit("ip").alias("type"), F.lit(f"10.10.0.{n}").alias("value"), F.lit("").alias("role")) for n in range(10, 23)],
                                   F.struct(F.lit("planet").alias("type"), F.lit("x").alias("value"), F.lit("").alias("role")))).alias("entities"),
        F.lit("what").alias("what"), F.when(k % 11 == 0, "traffic from China").otherwise("because").alias("why"), F.lit("").alias("not_this"), F.lit("act").alias("action"),
    )


def _cited_signals(t):
    c = F.col("c_custkey")
    ent = F.array(F.struct(F.lit("ip").alias("type"), F.concat(F.lit("10.10.0."), (c % 200).cast("string")).alias("value"), F.lit("source").alias("role")))
    return t.raw("customer").where(F.col("c_nationkey") > 3).select(
        F.concat(F.lit("s"), c.cast("string")).alias("signal_id"), F.col("c_mktsegment").alias("taxonomy"), (c % 5).cast("int").alias("severity_hint"), ent.alias("entities")
    )


_JUDGED = f"""sig AS (SELECT 's' || c_custkey AS signal_id, c_mktsegment AS taxonomy, c_custkey % 5 AS hint, c_custkey % 200 AS tail FROM customer WHERE c_nationkey > 3),
ev AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'N'),
f AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE 'Finding ' || o_orderpriority END AS title, {_SEV}[o_orderkey % 7 + 1] AS sev, a.signal_id AS s1, a.hint AS h1, a.taxonomy AS t1, a.tail AS l1,
  b.signal_id AS s2, b.hint AS h2, b.taxonomy AS t2, b.tail AS l2, ev.id AS eid, o_orderkey % 6 <> 5 AS cites FROM orders LEFT JOIN sig a ON o_orderkey % 6 <> 5 AND a.signal_id = 's' || o_custkey
  LEFT JOIN sig b ON o_orderkey % 6 <> 5 AND b.signal_id = 's' || (o_custkey + 1) LEFT JOIN ev ON o_orderkey % 5 <> 0 AND ev.id = o_orderkey),
g AS (SELECT *, s1 IS NOT NULL OR s2 IS NOT NULL AS has_signal, greatest(h1, h2) AS hint, CASE sev WHEN 'INFO' THEN 0 WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 WHEN 'SUSPECTED' THEN -1 ELSE 0 END AS req FROM f),
r AS (SELECT *, CASE WHEN title = '' THEN 'no title' WHEN NOT has_signal AND eid IS NULL THEN 'cites no known signal or event' WHEN k % 8 = 1 THEN 'no local evidence' END AS rejected,
  CASE WHEN req > hint + 1 THEN least(4, hint + 1) ELSE req END AS cl FROM g),
v AS (SELECT *, CASE WHEN NOT has_signal THEN -1 WHEN req = -1 THEN hint WHEN cl = 4 AND k % 8 IN (1, 2) THEN 3 ELSE cl END AS rated FROM r)"""


@query("e01_adjudicate_findings", "", f"""WITH {_JUDGED} SELECT k AS idx, 'F' || k AS finding_id, title, rated::BIGINT AS severity, CASE k % 3 WHEN 0 THEN 'high' ELSE 'medium' END AS confidence,
  CASE WHEN k % 4 = 0 THEN 'own.taxonomy' ELSE coalesce(t1, t2, 'agent.suspected') END AS taxonomy, CASE WHEN k % 2 = 0 THEN 'lan' ELSE 'perimeter' END AS zone, concat_ws(',', s1, s2) AS signal_ids,
  coalesce(CAST(eid AS VARCHAR), '') AS event_ids FROM v WHERE rejected IS NULL""")
def _(t):
    """Evidence checks (e01, e02) and severity bounds (e03)."""
    done = review.adjudicate_findings(_submitted(t), _cited_signals(t), q.where(t.fw, action="drop"), t.profile)
    return done.select("idx", "finding_id", "title", "severity", "confidence", "taxonomy", "zone", "signal_ids", "event_ids")


@query("e02_rejected_findings", "", f"WITH {_JUDGED} SELECT k AS idx, title, rejected FROM v WHERE rejected IS NOT NULL")
def _(t):
    return review.rejected_findings(_submitted(t), _cited_signals(t), q.where(t.fw, action="drop"), t.profile)


@query("e03_clamp_severity", "", f"""WITH {_JUDGED} SELECT k AS idx, rated::BIGINT AS severity, has_signal AND req > hint + 1 AND req <> -1 AS clamped, has_signal AND req <> -1 AND cl = 4 AND k % 8 IN (1, 2) AS lowered FROM v WHERE rejected IS NULL""")
def _(t):
    done = review.adjudicate_findings(_submitted(t), _cited_signals(t), q.where(t.fw, action="drop"), t.profile)
    has = lambda start: F.exists("adjustments", lambda a: a.startswith(start))
    return done.select("idx", "severity", has("severity clamped").alias("clamped"), has("severity lowered").alias("lowered"))


@query("e04_fill_entities", "", f"""WITH {_JUDGED} SELECT k AS idx, CASE WHEN k % 9 = 0 THEN (SELECT string_agg('ip:10.10.0.' || n || ':', '|' ORDER BY n) FROM range(10, 23) r(n)) ELSE concat_ws('|', 'ip:10.10.0.' || l1 || ':source', 'ip:10.10.0.' || l2 || ':source') END AS entities,
  k % 9 = 0 OR coalesce(l1 IN (10, 4), false) OR coalesce(l2 IN (10, 4), false) AS has_caveat, cites AS has_unknown, k % 5 <> 0 AS has_dropped FROM v WHERE rejected IS NULL""")
def _(t):
    done = review.adjudicate_findings(_submitted(t), _cited_signals(t), q.where(t.fw, action="drop"), t.profile)
    has = lambda start: F.exists("adjustments", lambda a: a.startswith(start))
    return done.select(
        "idx", "entities", (F.col("attribution_caveat") != "").alias("has_caveat"), has("dropped unknown").alias("has_unknown"), has("dropped event").alias("has_dropped")
    )


@query("e05_apply_suppressions", "findings", f"""WITH {_SUPPRESSIONS}, hit AS (SELECT f.finding_id, s.id, s.reason, row_number() OVER (PARTITION BY f.finding_id ORDER BY s.id) AS r FROM findings f JOIN supp s
    ON (s.taxonomy IS NULL OR s.taxonomy = f.taxonomy) AND (s.entity IS NULL OR list_contains(f.named, s.entity)) AND (s.title_contains IS NULL OR contains(lower(f.title), s.title_contains))
    AND (s.max_severity IS NULL OR f.severity <= CASE s.max_severity WHEN 'LOW' THEN 1 ELSE 3 END) AND (s.taxonomy IS NOT NULL OR s.entity IS NOT NULL OR s.title_contains IS NOT NULL))
  SELECT f.finding_id, h.id IS NOT NULL AS suppressed, h.id AS suppression_id, h.reason AS suppressed_reason FROM findings f LEFT JOIN (SELECT * FROM hit WHERE r = 1) h USING (finding_id)""")
def _(t):
    return review.apply_suppressions(t.findings, _suppressions(t)).select("finding_id", "suppressed", "suppression_id", "suppressed_reason")


@query("e06_rollup_status", "findings", """SELECT count(*) FILTER (WHERE severity = 4) AS criticals, count(*) FILTER (WHERE severity = 3) AS highs, count(*) FILTER (WHERE severity = 2) AS mediums,
  true AS canaries_ok, CASE WHEN count(*) FILTER (WHERE severity = 4) > 0 OR count(*) FILTER (WHERE severity = 3) >= 2 THEN 'RED' ELSE 'AMBER' END AS status FROM findings""")
def _(t):
    return review.rollup_status(t.findings)


@query("e07_clean_submissions", "", """SELECT 'watch' AS what, 'ip' AS a, trim(s_name) AS b, CAST(greatest(1, least(365, s_suppkey * 9 - 100)) AS VARCHAR) AS c FROM supplier WHERE s_suppkey % 4 > 0
  UNION ALL SELECT 'trend', kind, trim(s_name), '' FROM (SELECT s_name, s_suppkey, upper(['new', 'Recurring', 'odd', 'RESOLVED'][s_suppkey % 4 + 1]) AS kind FROM supplier) WHERE kind <> 'ODD'
  UNION ALL SELECT 'action', CAST(CASE WHEN s_suppkey % 3 = 0 THEN 5 ELSE s_suppkey % 7 END AS VARCHAR), trim(s_name), '' FROM supplier WHERE s_suppkey % 5 > 0""")
def _(t):
    s = F.col("s_suppkey")
    sup = t.raw("supplier")
    name = F.concat(F.lit(" "), "s_name")
    watch = review.clean_watchlist_updates(sup.select(
        F.lit(None).cast("string").alias("entity_type"), F.when(s % 4 > 0, name).alias("entity_value"), F.lit("").alias("reason"), (s * 9 - 100).alias("expires_days")))
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("new", "Recurring", "odd", "RESOLVED")]), (s % 4 + 1).cast("int"))
    trend = review.clean_trends(sup.select(kinds.alias("kind"), name.alias("text")))
    action = review.clean_actions(sup.select(
        F.when(s % 3 == 0, "soon").otherwise((s % 7).cast("string")).alias("priority"), F.when(s % 5 > 0, name).alias("text"), F.lit(None).cast("string").alias("command")))
    text = lambda c: F.col(c).cast("string")
    return (
        watch.select(F.lit("watch").alias("what"), F.col("entity_type").alias("a"), F.col("entity_value").alias("b"), text("expires_days").alias("c"))
        .unionByName(trend.select(F.lit("trend").alias("what"), F.col("kind").alias("a"), F.col("text").alias("b"), F.lit("").alias("c")))
        .unionByName(action.select(F.lit("action").alias("what"), text("priority").alias("a"), F.col("text").alias("b"), F.lit("").alias("c")))
    )


@query("e08_delivery_gate", "fw dns cloud findings", f"""WITH {_HEALTH} SELECT 'RED' AS status, (SELECT count(*) FROM health WHERE state NOT IN ('OK', 'DEGRADED')) AS unusable_sources, 4::BIGINT AS worst_severity, true AS important, true AS deliver
  WHERE (SELECT max(severity) FROM findings) = 4""")
def _(t):
    health = quality.classify_health(quality.collection_stats(_collected(t)), _manifest(t))
    gate = review.delivery_gate(review.rollup_status(t.findings), health, t.findings, important_only=True, min_severity=4)
    return gate.select("status", "unusable_sources", "worst_severity", "important", "deliver")


# ----- reporting


def _some_signals(t):
    k = F.col("o_orderkey")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    return t.raw("orders").select(
        F.concat(F.lit("sig"), k.cast("string")).alias("signal_id"), (F.col("o_custkey") % 5).cast("int").alias("severity_hint"),
        (F.col("o_custkey") % 9 / 10.0).alias("confidence"), pick(("a.one", "a.two", "b.one", "b.two"), k % 4).alias("taxonomy"),
        F.when(k % 3 > 0, F.concat(F.lit("note "), (k % 7).cast("string"))).alias("note"), (k % 10 == 0).alias("is_canary"),
    )


_SIGS = """sigs AS (SELECT 'sig' || o_orderkey AS signal_id, o_custkey % 5 AS severity_hint, o_custkey % 9 / 10.0 AS confidence, ['a.one', 'a.two', 'b.one', 'b.two'][o_orderkey % 4 + 1] AS taxonomy,
  CASE WHEN o_orderkey % 3 > 0 THEN 'note ' || (o_orderkey % 7) END AS note, o_orderkey % 10 = 0 AS is_canary FROM orders)"""


@query("w10_rank_signals", "", f"""WITH {_SIGS} SELECT signal_id, severity_hint::BIGINT AS severity_hint, round(confidence, 6)::DOUBLE AS confidence FROM sigs WHERE NOT is_canary ORDER BY severity_hint DESC, confidence DESC, signal_id LIMIT 60""")
def _(t):
    return reporting.rank_signals(_some_signals(t)).select("signal_id", "severity_hint", "confidence")


def _some_metrics(t):
    k = F.col("p_partkey")
    return t.raw("part").select(
        F.col("p_brand").alias("section"), F.col("p_size").alias("ord"), F.concat(F.lit("m"), k.cast("string")).alias("key"),
        F.col("p_retailprice").alias("value_num"), F.lit(None).cast("string").alias("value_text"), F.lit(None).cast("string").alias("unit"), F.col("p_name").alias("label"),
    )


@query("w11_top_metrics_per_section", "", """SELECT section, key, rank, prior, round(CASE WHEN prior <> 0 THEN (value_num - prior) / abs(prior) * 100 END, 6) AS delta_pct FROM (SELECT p_brand AS section, 'm' || p_partkey AS key, p_retailprice AS value_num,
  row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_retailprice DESC, 'm' || p_partkey) AS rank, CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 50)::DOUBLE END AS prior FROM part) WHERE rank <= 25""")
def _(t):
    k = F.col("p_partkey")
    prior = t.raw("part").where(k % 2 == 0).select(F.concat(F.lit("m"), k.cast("string")).alias("key"), (k % 50).cast("double").alias("prior"))
    return reporting.top_metrics_per_section(_some_metrics(t), prior).select("section", "key", "rank", "prior", "delta_pct")


@query("w12_signal_rollup", "", f"""WITH {_SIGS}, n AS (SELECT taxonomy, note, count(*) AS n, row_number() OVER (PARTITION BY taxonomy ORDER BY count(*) DESC, note DESC) AS r FROM sigs WHERE note IS NOT NULL GROUP BY taxonomy, note)
  SELECT s.taxonomy, count(*) AS signals, count(*) FILTER (WHERE severity_hint <= 1) AS weak_signals, count(*) FILTER (WHERE severity_hint <= 1) >= 5 AS as_table, max(CASE WHEN n.n >= 2 THEN n.note END) AS shared_note
  FROM sigs s LEFT JOIN n ON n.taxonomy = s.taxonomy AND n.r = 1 GROUP BY s.taxonomy""")
def _(t):
    return reporting.signal_rollup(_some_signals(t))


@query("e09_report_sections", "fw dns", """SELECT 'lan' AS zone, (SELECT count(DISTINCT client_ip) FROM dns WHERE src_zone = 'lan')::DOUBLE AS dns, (SELECT count(*) FROM (SELECT src_ip FROM fw WHERE src_zone = 'lan' UNION SELECT dst_ip FROM fw WHERE dst_zone = 'lan'))::DOUBLE AS fw
  UNION ALL SELECT 'iot', (SELECT count(DISTINCT client_ip) FROM dns WHERE src_zone = 'iot'), (SELECT count(*) FROM (SELECT src_ip FROM fw WHERE src_zone = 'iot' UNION SELECT dst_ip FROM fw WHERE dst_zone = 'iot'))
  UNION ALL SELECT 'dmz', (SELECT count(DISTINCT client_ip) FROM dns WHERE src_zone = 'dmz'), (SELECT count(*) FROM (SELECT src_ip FROM fw WHERE src_zone = 'dmz' UNION SELECT dst_ip FROM fw WHERE dst_zone = 'dmz'))""")
def _(t):
    from sentrylake.operators.segments import zone_metrics

    return reporting.segment_client_counts(reporting.report_sections(zone_metrics(t.fw.unionByName(t.dns), t.profile)))


@query("j10_signal_samples", "fw", """WITH s AS (SELECT DISTINCT src_ip FROM fw WHERE action = 'drop' AND proto = 'udp'), sup AS (SELECT 'sig.' || src_ip AS signal_id, 'fw:' || s_suppkey || ':1' AS dedup_key FROM s JOIN supplier ON src_ip = '10.10.0.' || s_suppkey),
  byk AS (SELECT sup.signal_id, 0 AS choice, f.id, f.ts, f.dedup_key FROM sup JOIN fw f USING (dedup_key)), bye AS (SELECT 'sig.' || src_ip AS signal_id, 1 AS choice, id, ts, dedup_key FROM fw WHERE src_ip IN (SELECT src_ip FROM s)),
  a AS (SELECT *, min(choice) OVER (PARTITION BY signal_id) AS m FROM (SELECT * FROM byk UNION ALL SELECT * FROM bye)),
  r AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY ts DESC, id, dedup_key) AS rank FROM a WHERE choice = m)
  SELECT signal_id, rank, id, ts, dedup_key, CASE choice WHEN 0 THEN 'dedup_key' ELSE 'src_ip' END AS field FROM r WHERE rank <= 5""")
def _(t):
    ips = q.distinct_values(t.fw, "src_ip", action="drop", proto="udp")
    signals = ips.select(F.concat(F.lit("sig."), "value").alias("signal_id"), F.array(scalars.entity("ip", "value", "source")).alias("entities"))
    keys = t.raw("supplier").select(
        F.concat(F.lit("sig.10.10.0."), F.col("s_suppkey").cast("string")).alias("signal_id"), F.concat(F.lit("fw:"), F.col("s_suppkey").cast("string"), F.lit(":1")).alias("dedup_key")
    )
    return reporting.signal_samples(signals, t.fw, keys, 5)


@query("k10_report", "findings metrics", """SELECT 'run1' AS run_id, 'findings' AS part, 9 - severity || ' ' || title AS ord, finding_id AS name, count(*) OVER () AS n FROM findings
  UNION ALL SELECT 'run1', 'metrics', p_brand || ' ' || lpad(CAST(p_size AS VARCHAR), 9, '0'), 'm' || p_partkey, count(*) OVER () FROM part""")
def _(t):
    """A report written as JSON lines and read back."""
    from sentrylake.sources.sinks import write_report_json

    findings = t.findings.select("finding_id", "title", "severity", "taxonomy", "entities")
    path = scratch_path(t.spark, "report")
    write_report_json(reporting.report_rows("run1", findings=findings, metrics=_some_metrics(t)), path)
    rows = t.spark.read.schema("part string, ord string, body string, run_id string").json(path)
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    name = F.coalesce(F.get_json_object("body", "$.finding_id"), F.get_json_object("body", "$.key"))
    return rows.join(sizes, "part").select("run_id", "part", "ord", name.alias("name"), "n")
