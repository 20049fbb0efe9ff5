"""Registered queries: joins, ordered analytics, and the detectors with their metrics.

Thresholds are lowered where the given tables would otherwise trip nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake.operators import (
    correlate,
    indicators,
    logons,
    match,
    perimeter,
    periodic,
    population,
    resolver,
    segments,
    series,
    trends,
    volume,
)
from sentrylake.operators import history as H
from sentrylake.operators import query as q
from sentrylake.plans.lookups import CAVEAT_SQL, GENERATED_SQL, LABEL_SQL, _ENTROPY
from sentrylake.plans.registry import query
from sentrylake.plans.tables import AS_OF, DNS_SPLIT, SPLIT
from sentrylake.session import scratch_path
from sentrylake.sources.entities import EntityStore


def bare(signals: DataFrame) -> DataFrame:
    """Signal without the texts that only repeat the other columns."""
    return signals.drop("analyzer", "title", "taxonomy")


def values(metrics: DataFrame) -> DataFrame:
    return metrics.select("key", "value_num")


def ents(*items: str) -> str:
    """SQL for an entity list of fixed length: each item is type|value expression|role."""
    parts = []
    for item in items:
        kind, value, role = item.split("|")
        parts.append(f"'{kind}:' || {value} || ':{role}'")
    return " || '|' || ".join(parts)


def listed(kind: str, value: str, role: str, order: str | None = None) -> str:
    """SQL for an entity list aggregated from rows."""
    return f"string_agg('{kind}:' || {value} || ':{role}', '|' ORDER BY {order or value})"


HOURS = "(epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0"
INSIDE = "starts_with({0}, '10.')"
BENIGN = ("({0} = 'the.example.com' OR {0} = 'example.org' OR {0} LIKE '%.example.org' OR {0} = 'local' OR {0} LIKE '%.local')")

# ----- matching

_V4 = ("(CAST(split_part({0},'.',1) AS BIGINT)*16777216 + CAST(split_part({0},'.',2) AS BIGINT)*65536"
       " + CAST(split_part({0},'.',3) AS BIGINT)*256 + CAST(split_part({0},'.',4) AS BIGINT))")
_IN_NET = ("({ip} >> (32 - CAST(split_part(i.value,'/',2) AS INTEGER))) = ({net} >> (32 - CAST(split_part(i.value,'/',2) AS INTEGER)))"
           ).format(ip=_V4.format("v.value"), net=_V4.format("split_part(i.value,'/',1)"))
IP_MATCHES = f"""ips AS (SELECT DISTINCT src_ip AS value FROM fw UNION SELECT DISTINCT dst_ip FROM fw),
ip_hits AS (SELECT v.value, i.value AS indicator, i.kind, i.severity, i.tier, i.source FROM ips v JOIN iocs i ON i.kind = 'ip' AND i.value = v.value
  UNION ALL SELECT v.value, i.value, i.kind, i.severity, i.tier, i.source FROM ips v JOIN iocs i ON i.kind = 'cidr' AND {_IN_NET})"""
NAME_MATCHES = """names AS (SELECT DISTINCT domain AS value FROM dns),
name_hits AS (SELECT v.value, i.value AS indicator, i.kind, i.severity, i.tier, i.source FROM names v JOIN iocs i
  ON i.kind IN ('domain', 'domain_suffix') AND (v.value = i.value OR ends_with(v.value, '.' || i.value)))"""


@query("j01_match_exact_ips", "fw iocs", f"WITH {IP_MATCHES} SELECT value, indicator, kind FROM ip_hits WHERE kind = 'ip'")
def _(t):
    return match.match_exact_ips(q.all_traffic_ips(t.fw), t.indicators).select("value", "indicator", "kind")


@query("j02_match_networks", "fw iocs", f"WITH {IP_MATCHES} SELECT value, indicator, severity::BIGINT AS severity, tier FROM ip_hits WHERE kind = 'cidr'")
def _(t):
    return match.match_networks(q.all_traffic_ips(t.fw), t.indicators).select("value", "indicator", "severity", "tier")


@query("j03_match_domains", "dns iocs", f"WITH {NAME_MATCHES} SELECT value, indicator, kind, tier FROM name_hits")
def _(t):
    return match.match_domains(q.all_dns_domains(t.dns), t.indicators).select("value", "indicator", "kind", "tier")


@query("j03_not_under", "dns", """SELECT DISTINCT domain FROM dns d WHERE NOT EXISTS (SELECT 1 FROM pages
  WHERE page_id % 5 = 0 AND (d.domain = regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) OR ends_with(d.domain, '.' || regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))))""")
def _(t):
    host = F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
    covered = t.raw("pages").where(F.col("page_id") % 5 == 0).select(host.alias("suffix"))
    return match.not_under(t.dns.select("domain").distinct(), covered)


@query("j04_novelty", "dns", f"""SELECT DISTINCT domain AS value FROM dns WHERE ts >= TIMESTAMP '{DNS_SPLIT}'
  AND domain NOT IN (SELECT domain FROM dns WHERE ts < TIMESTAMP '{DNS_SPLIT}')""")
def _(t):
    """Three earlier runs in the entity store, two of them merged."""
    store, earlier = EntityStore(t.spark, scratch_path(t.spark, "baseline")), t.dns.where(F.col("ts") < H.instant(DNS_SPLIT))
    for k in range(3):
        if k == 2:
            store.compact()
        store.observe(f"run{k}", H.observations(earlier.where(F.pmod(F.hash("domain"), F.lit(3)) == k), f"run{k}", "1990-01-01 00:00:00"))
    return store.novel(q.distinct_values(t.dns.where(F.col("ts") >= H.instant(DNS_SPLIT)), "domain"), "domain", DNS_SPLIT)


_RUNS = """runs AS (SELECT 'run' || (o_orderkey % 20) AS run_id, max(o_orderdate) AS started_at,
  CASE WHEN o_orderkey % 20 <> 7 THEN max(o_orderdate) END AS finished_at FROM orders GROUP BY o_orderkey % 20)"""


def _runs(t):
    k = F.col("o_orderkey") % 20
    runs = t.raw("orders").groupBy(k.alias("k")).agg(F.max(F.col("o_orderdate").cast("timestamp")).alias("started_at"))
    return runs.select(
        F.concat(F.lit("run"), F.col("k").cast("string")).alias("run_id"), "started_at",
        F.when(F.col("k") != 7, F.col("started_at")).alias("finished_at"),
    )


_LATEST = "(SELECT run_id FROM runs WHERE finished_at IS NOT NULL AND run_id <> 'run3' ORDER BY started_at DESC, run_id DESC LIMIT 1)"


@query("j05_prior_metrics", "metrics", f"""WITH {_RUNS} SELECT key, round(value_num, 6) AS prior FROM metrics
  WHERE run_id = {_LATEST} AND value_num IS NOT NULL""")
def _(t):
    return H.prior_metrics(_runs(t), t.metrics, "run3")


@query("j06_shared_hosts", "fw dns", "SELECT DISTINCT src_ip AS value FROM fw WHERE starts_with(src_ip, '10.') AND src_ip IN (SELECT client_ip FROM dns)")
def _(t):
    return correlate.shared_hosts(t.events, t.profile)


_WATCH = f"""parts AS (SELECT 'address' AS part, src_ip AS value FROM fw UNION ALL SELECT 'address', dst_ip FROM fw
  UNION ALL SELECT 'device', device FROM fw UNION ALL SELECT 'address', client_ip FROM dns UNION ALL SELECT 'domain', domain FROM dns),
watched AS (SELECT * FROM watchlist WHERE expires_at IS NULL OR expires_at >= TIMESTAMP '{AS_OF}'),
hits AS (SELECT entity_type, entity_value, reason, expires_at, count(*) AS n FROM watched JOIN parts ON entity_value = value
  AND ((entity_type = 'domain' AND part = 'domain') OR (entity_type IN ('ip', 'host') AND part = 'address') OR (entity_type = 'host' AND part = 'device'))
  GROUP BY entity_type, entity_value, reason, expires_at)"""


@query("j07_watch_activity", "fw dns watchlist", f"WITH {_WATCH} SELECT entity_type, entity_value, reason, expires_at, n FROM hits")
def _(t):
    return correlate.watch_activity(t.fw.unionByName(t.dns), t.watchlist, AS_OF)


_SWEEPS = """sweeps AS (SELECT * FROM (SELECT regexp_extract(src_ip, '^(\\d+\\.\\d+\\.\\d+)', 1) || '.0/24' AS prefix, count(DISTINCT src_ip) AS sources,
  count(*) AS hits FROM fw WHERE action = 'drop' GROUP BY 1)
  WHERE sources >= {least} AND hits::DOUBLE / sources <= {max})"""


@query("j08_sweep_exclusion", "fw", f"""WITH {_SWEEPS.format(max='100000', least=40)} SELECT src_ip, count(*) AS hits FROM fw WHERE action = 'drop'
  AND regexp_extract(src_ip, '^(\\d+\\.\\d+\\.\\d+)', 1) || '.0/24' NOT IN (SELECT prefix FROM sweeps) GROUP BY src_ip""")
def _(t):
    from sentrylake.functions import net

    sweeps = perimeter.sweep_prefixes(t.fw, min_sources=40, max_hits_per_source=100000.0).select("prefix")
    per = q.top(t.fw, "src_ip", None, action="drop").withColumn("prefix", net.subnet24("value"))
    return per.join(sweeps, "prefix", "left_anti").select(F.col("value").alias("src_ip"), F.col("n").alias("hits"))


# ----- ordered analytics

_BEACON = """per AS (SELECT client_ip, domain, count(*) AS samples, count(DISTINCT ts) - 1 AS gaps, min(ts) AS a, max(ts) AS b FROM dns
  WHERE NOT {benign} GROUP BY client_ip, domain),
gapped AS (SELECT client_ip, domain, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY client_ip, domain ORDER BY ts))) / 1000000.0 AS gap
  FROM (SELECT DISTINCT client_ip, domain, ts FROM dns)),
sd AS (SELECT client_ip, domain, stddev_pop(gap) AS jitter FROM gapped WHERE gap > 0 GROUP BY client_ip, domain),
scored AS (SELECT *, span_s / gaps AS interval_seconds, span_s / 3600 AS span_hours, jitter / (span_s / gaps) AS cv FROM (
  SELECT *, (epoch_us(b) - epoch_us(a)) / 1000000.0 AS span_s FROM per JOIN sd USING (client_ip, domain)) WHERE gaps >= 5 AND samples >= 6 AND span_s >= 10800),
beacons AS (SELECT client_ip, domain, samples, interval_seconds, jitter AS jitter_seconds, cv, span_hours,
  0.45 + 0.5 * (0.6 * greatest(0, 1 - cv / 0.6) + 0.4 * least(1, gaps / 60.0)) AS confidence FROM scored
  WHERE interval_seconds BETWEEN 30 AND 10000000 AND cv <= 0.6)""".format(benign=BENIGN.format("domain"))
_BEACON_LIMITS = {"min_samples": 6, "max_cv": 0.6, "max_interval_s": 1e7}


@query("w01_beacon_score", "dns", f"""WITH {_BEACON} SELECT client_ip, domain, samples::BIGINT AS samples, round(interval_seconds, 6) AS interval_seconds,
  round(jitter_seconds, 6) AS jitter_seconds, round(cv, 6) AS cv, round(span_hours, 6) AS span_hours, round(confidence, 6) AS confidence FROM beacons""")
def _(t):
    return periodic.dns_series(t.dns, t.profile, **_BEACON_LIMITS)


_WINDOW = """seen AS (SELECT DISTINCT "user" AS m, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s FROM wifi WHERE action = 'deauth'),
counts AS (SELECT e.s AS e, count(DISTINCT x.m) AS n FROM (SELECT DISTINCT s FROM seen) e JOIN seen x ON x.s BETWEEN e.s - 3600 AND e.s GROUP BY e.s),
best AS (SELECT e, n FROM counts ORDER BY n DESC, e LIMIT 1)"""


@query("w02_widest_window", "wifi", f"""WITH {_WINDOW} SELECT (SELECT make_timestamp(min(s) * 1000000) FROM seen, best WHERE s BETWEEN e - 3600 AND e) AS window_start,
  n AS distinct_members, (SELECT string_agg(m, ',' ORDER BY m) FROM (SELECT DISTINCT m FROM seen, best WHERE s BETWEEN e - 3600 AND e ORDER BY m LIMIT 20)) AS member_list FROM best""")
def _(t):
    return series.widest_window(q.where(t.wifi, action="deauth"), "user", window_s=3600)


_SHAPE = """hours AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM fw WHERE action = 'drop' GROUP BY 1),
shape AS (SELECT count(*) AS hours_observed, median(n) AS median_hourly, avg(n) AS mean_hourly, max(n) AS peak_count,
  (SELECT hour FROM hours ORDER BY n DESC, hour LIMIT 1) AS peak_hour FROM hours)"""


@query("w03_hourly_shape", "fw", f"WITH {_SHAPE} SELECT hours_observed, round(median_hourly, 6) AS median_hourly, round(mean_hourly, 6) AS mean_hourly, peak_hour, peak_count FROM shape")
def _(t):
    return series.hourly_shape(q.hourly(t.fw, action="drop"))


@query("w04_peer_mean", "dns", """SELECT client_ip, total, round((sum(total) OVER () - total)::DOUBLE / (count(*) OVER () - 1), 6) AS peers
  FROM (SELECT client_ip, count(*) AS total FROM dns GROUP BY client_ip)""")
def _(t):
    stats = q.dns_client_stats(t.dns).select("client_ip", "total")
    return stats.withColumn("peers", series.peer_mean(stats, "total"))


@query("w05_top_against_peers", "wifi", """WITH c AS (SELECT "user" AS value, count(*) AS n FROM wifi WHERE action = 'deauth' GROUP BY 1),
  top AS (SELECT value, n FROM c ORDER BY n DESC, value LIMIT 1)
  SELECT value, n, round((SELECT median(n) FROM c WHERE value <> (SELECT value FROM top)), 6) AS peer_median, (SELECT count(*) FROM c) AS members FROM top""")
def _(t):
    return series.top_against_peers(q.top(t.wifi, "user", None, action="deauth"), "value", "n")


@query("w06_port_concentration", "fw", """WITH p AS (SELECT src_ip, dst_port, count(*) AS n FROM fw WHERE action = 'drop' GROUP BY 1, 2)
  SELECT src_ip, top_port::BIGINT AS top_port, n AS top_port_hits, hits::BIGINT AS hits, round(n / hits::DOUBLE, 6) AS port_concentration FROM (
  SELECT src_ip, dst_port AS top_port, n, sum(n) OVER (PARTITION BY src_ip) AS hits,
    row_number() OVER (PARTITION BY src_ip ORDER BY n DESC, dst_port) AS r FROM p) WHERE r = 1""")
def _(t):
    return series.port_concentration(t.fw, action="drop")


_LADDERS = """low AS (SELECT src_ip, dst_ip, proto, ttl, count(*) AS n, min(ts) AS a, max(ts) AS b FROM fw WHERE ttl <= 30 GROUP BY 1, 2, 3, 4),
islands AS (SELECT *, ttl - row_number() OVER (PARTITION BY src_ip, dst_ip, proto ORDER BY ttl) AS g FROM low),
ladders AS (SELECT * FROM (SELECT src_ip, dst_ip, proto, min(ttl) AS ttl_start, count(*) FILTER (WHERE g = first_g) AS hops, sum(n) AS probes,
  min(a) AS first_seen, max(b) AS last_seen FROM (SELECT *, min(ttl) OVER (PARTITION BY src_ip, dst_ip, proto) - 1 AS first_g FROM islands)
  GROUP BY 1, 2, 3) WHERE ttl_start <= 3 AND hops >= {hops})"""


@query("w07_ttl_ladders", "fw", f"""WITH {_LADDERS.format(hops=2)} SELECT src_ip, dst_ip, proto, ttl_start::BIGINT AS ttl_start, hops, probes::BIGINT AS probes, first_seen, last_seen FROM ladders""")
def _(t):
    return series.ttl_ladders(t.fw, min_hops=2)


@query("w08_recent_runs", "", f"""WITH {_RUNS} SELECT run_id, started_at, (SELECT count(*) + 1 FROM runs) AS next_number, run_id = {_LATEST} AS is_latest
  FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 12""")
def _(t):
    runs = _runs(t)
    latest = H.last_finished_run(runs, "run3").select("run_id").scalar()
    return H.recent_runs(runs, 12).select(
        "run_id", "started_at", H.next_run_number(runs).scalar().alias("next_number"), (F.col("run_id") == latest).alias("is_latest")
    )


@query("w09_metric_history", "metrics", f"""SELECT ts, round(value_num, 6) AS value_num, value_text FROM metrics WHERE key = 'fw.drops'
  AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY""")
def _(t):
    return H.metric_history(t.metrics, "fw.drops", AS_OF, 90)


# ----- firewall


@query("f01_volume_metrics", "fw wifi", """SELECT key, value_num::DOUBLE AS value_num FROM (
  SELECT 'fw.total' AS key, count(*) AS value_num FROM fw UNION ALL SELECT 'fw.drops', count(*) FROM fw WHERE action = 'drop'
  UNION ALL SELECT 'fw.accepts', count(*) FROM fw WHERE action = 'accept' UNION ALL SELECT 'fw.rejects', count(*) FROM fw WHERE action = 'reject'
  UNION ALL SELECT 'sys.events', 0 UNION ALL SELECT 'fw.unique_sources', count(DISTINCT src_ip) FROM fw
  UNION ALL SELECT 'fw.proto.' || proto, count(*) FROM fw GROUP BY proto UNION ALL SELECT 'fw.iface.' || iface_in, count(*) FROM fw GROUP BY iface_in)""")
def _(t):
    return values(perimeter.volume_metrics(t.fw.unionByName(t.wifi)))


@query("f02_port_metrics", "fw", """WITH p AS (SELECT dst_port, count(*) AS n, count(DISTINCT src_ip) AS s FROM fw WHERE action = 'drop' GROUP BY 1)
  SELECT key, value_num::DOUBLE AS value_num FROM (SELECT * FROM (SELECT 'fw.port.hits.' || dst_port AS key, n AS value_num FROM p ORDER BY n DESC, dst_port LIMIT 20)
  UNION ALL SELECT * FROM (SELECT 'fw.port.sources.' || dst_port, s FROM p ORDER BY s DESC, dst_port LIMIT 20)
  UNION ALL SELECT 'fw.attack_port.' || dst_port, n FROM p WHERE dst_port IN (22, 23, 445, 3389))""")
def _(t):
    return values(perimeter.port_metrics(t.fw, t.profile))


@query("f03_hourly_metrics", "fw", f"""WITH {_SHAPE} SELECT * FROM (SELECT 'fw.hourly.median' AS key, round(median_hourly, 6) AS value_num, NULL::VARCHAR AS value_text FROM shape
  UNION ALL SELECT 'fw.hourly.mean', round(mean_hourly, 6), NULL FROM shape UNION ALL SELECT 'fw.peak_hour', NULL, strftime(peak_hour, '%Y-%m-%d %H:00') FROM shape
  UNION ALL SELECT 'fw.peak_hour_count', peak_count::DOUBLE, NULL FROM shape)""")
def _(t):
    return perimeter.hourly_metrics(t.fw).select("key", "value_num", "value_text")


@query("f03_volume_spike", "fw", f"""WITH {_SHAPE}, lead AS (SELECT src_ip, count(*) AS n FROM fw WHERE action = 'drop' GROUP BY 1 ORDER BY n DESC, src_ip LIMIT 3)
  SELECT 'fw.spike.' || strftime(peak_hour, '%Y-%m-%dT%H:00') AS signal_id, 1::BIGINT AS severity_hint, 0.55::DOUBLE AS confidence, 'host:perimeter:target' AS entities,
  strftime(peak_hour, '%Y-%m-%d %H:00') AS hour, peak_count AS count, round(median_hourly, 6) AS median_hourly, round(peak_count / median_hourly, 6) AS multiple_of_median,
  hours_observed, (SELECT string_agg(src_ip || ':' || n, '|' ORDER BY n DESC, src_ip) FROM lead) AS top_sources FROM shape WHERE hours_observed >= 6 AND peak_count > 1.5 * median_hourly""")
def _(t):
    return bare(perimeter.volume_spike(t.fw, multiple=1.5))


@query("f04_mass_sweep", "fw", f"""WITH {_SWEEPS.format(max='100000', least=15)} SELECT 'fw.sweep.' || replace(prefix, '/', '_') AS signal_id, 0::BIGINT AS severity_hint, 0.8::DOUBLE AS confidence,
  {ents('ip|prefix|source')} AS entities, prefix, sources AS distinct_sources, hits AS total_hits, round(hits::DOUBLE / sources, 6) AS hits_per_source FROM sweeps""")
def _(t):
    return bare(perimeter.mass_sweep(t.fw, max_hits_per_source=100000.0))


_RECUR = """recur AS (SELECT v AS value, count(DISTINCT run_id) AS prior_runs FROM (SELECT run_id, unnest(named) AS v FROM findings
  WHERE taxonomy = '{tax}' AND ts >= TIMESTAMP '{as_of}' - INTERVAL 30 DAY) GROUP BY v)"""
_SHAPES = f"""shapes AS (SELECT src_ip, count(*) AS hits, count(*) FILTER (WHERE proto = 'tcp' AND src_port IN (80, 443)) AS back,
  count(DISTINCT dst_port) AS ports, min(ts) AS first_seen, max(ts) AS last_seen, min(ttl) AS ttl_min, max(ttl) AS ttl_max, round({HOURS}, 2) AS duration_hours
  FROM fw WHERE action = 'drop' GROUP BY src_ip),
tops AS (SELECT src_ip, dst_port AS top_port, n AS top_hits FROM (SELECT src_ip, dst_port, count(*) AS n,
  row_number() OVER (PARTITION BY src_ip ORDER BY count(*) DESC, dst_port) AS r FROM fw WHERE action = 'drop' GROUP BY 1, 2) WHERE r = 1)"""


@query("f05_persistent_prober", "fw findings", f"""WITH {_SWEEPS.format(max='4', least=15)}, {_SHAPES}, {_RECUR.format(tax='scan.persistent_prober', as_of=AS_OF)}
  SELECT 'fw.prober.' || src_ip || '.' || top_port AS signal_id, CASE WHEN w THEN 2 ELSE 1 END::BIGINT AS severity_hint, CASE WHEN w THEN 0.75 ELSE 0.6 END::DOUBLE AS confidence,
  {ents('ip|src_ip|source', 'port|top_port|destination')} AS entities, hits, round(duration_hours, 6) AS duration_hours, first_seen, last_seen, ports AS distinct_dst_ports,
  top_port::BIGINT AS top_port, top_hits AS top_port_hits, round(top_hits::DOUBLE / hits, 6) AS port_concentration, ttl_min::BIGINT AS ttl_min, ttl_max::BIGINT AS ttl_max,
  w AS targets_attack_surface_port, coalesce(prior_runs, 0) AS prior_runs
  FROM (SELECT *, top_port IN (22, 23, 445, 3389) AS w FROM shapes JOIN tops USING (src_ip)) LEFT JOIN recur ON value = src_ip
  WHERE hits >= 20 AND duration_hours >= 2 AND ports <= 40 AND top_hits::DOUBLE / hits >= 0.2 AND back <= hits * 0.8 AND NOT starts_with(src_ip, '10.')
  AND regexp_extract(src_ip, '^(\\d+\\.\\d+\\.\\d+)', 1) || '.0/24' NOT IN (SELECT prefix FROM sweeps)""")
def _(t):
    b = t.baseline(t.fw.where(F.col("ts") < H.instant(SPLIT)), AS_OF)
    return bare(perimeter.persistent_prober(t.fw, t.profile, b, min_hits=20, max_ports=40, min_concentration=0.2))


@query("f06_pattern_metrics", "fw", f"""WITH {_SWEEPS.format(max='100000', least=15)}, {_SHAPES} SELECT key, n::DOUBLE AS value_num FROM (
  SELECT 'fw.conntrack_return' AS key, count(*) AS n FROM fw WHERE action = 'drop' AND proto = 'tcp' AND src_port IN (80, 443)
  UNION ALL SELECT 'fw.sweeps', count(*) FROM sweeps
  UNION ALL SELECT 'fw.probers', count(*) FROM shapes JOIN tops USING (src_ip) WHERE hits >= 50 AND duration_hours >= 2 AND ports <= 3
    AND top_hits::DOUBLE / hits >= 0.7 AND back <= hits * 0.8 AND NOT starts_with(src_ip, '10.')
    AND regexp_extract(src_ip, '^(\\d+\\.\\d+\\.\\d+)', 1) || '.0/24' NOT IN (SELECT prefix FROM sweeps))""")
def _(t):
    return values(perimeter.pattern_metrics(t.fw, t.profile, max_hits_per_source=100000.0))


@query("f07_stepped_ttl", "fw", f"""SELECT 'fw.stepped_ttl.' || src_ip AS signal_id, 1::BIGINT AS severity_hint, 0.5::DOUBLE AS confidence, {ents('ip|src_ip|source')} AS entities,
  hits, ttl_min::BIGINT AS ttl_min, ttl_max::BIGINT AS ttl_max, ports AS distinct_dst_ports, round(h, 2) AS duration_hours FROM (
  SELECT src_ip, count(*) AS hits, min(ttl) AS ttl_min, max(ttl) AS ttl_max, count(DISTINCT dst_port) AS ports, {HOURS} AS h FROM fw
  WHERE action = 'drop' AND proto = 'udp' GROUP BY src_ip) WHERE ttl_min <= 8 AND ttl_max - ttl_min >= 2 AND hits >= 10""")
def _(t):
    return bare(perimeter.stepped_ttl(t.fw, min_spread=2))


_TRUST = "CASE {0} WHEN 'lan' THEN 'trusted' WHEN 'iot' THEN 'untrusted' WHEN 'dmz' THEN 'semi-trusted' ELSE 'unknown' END"
_CROSS = f"""crossing AS (SELECT l.*, CASE WHEN starts_with(src_ip, '10.10.50.') THEN 'iot' ELSE 'lan' END AS sz, CASE WHEN starts_with(dst_ip, '10.10.50.') THEN 'iot' ELSE 'lan' END AS dz
  FROM ladders l WHERE starts_with(src_ip, '10.') AND starts_with(dst_ip, '10.')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY probes DESC, dst_ip, proto) AS r FROM crossing WHERE sz <> dz)"""


@query("f08_internal_traceroute", "fw findings", f"""WITH {_LADDERS.format(hops=2)}, {_CROSS}, {_RECUR.format(tax='recon.internal_traceroute', as_of=AS_OF)}
  SELECT 'recon.traceroute.' || src_ip AS signal_id, CASE WHEN n >= 3 OR (sz = 'iot') THEN 2 ELSE 1 END::BIGINT AS severity_hint, 0.8::DOUBLE AS confidence,
  'ip:' || src_ip || ':source|' || first5 AS entities, sz AS source_zone, {_TRUST.format('sz')} AS source_trust, sz = 'iot' AS into_more_trusted_zone, dests AS destinations,
  n AS distinct_destinations, coalesce(prior_runs, 0) AS prior_runs FROM (
  SELECT src_ip, sz, count(*) AS n, string_agg('ip:' || dst_ip || ':destination', '|' ORDER BY r) FILTER (WHERE r <= 5) AS first5,
    string_agg(r || ':' || dst_ip || ':' || dz || ':' || proto || ':' || ttl_start || ':' || (ttl_start + hops - 1) || ':' || probes || ':' ||
      strftime(first_seen, '%Y-%m-%d %H:%M:%S') || ':' || strftime(last_seen, '%Y-%m-%d %H:%M:%S'), '|' ORDER BY r) FILTER (WHERE r <= 10) AS dests
  FROM ranked GROUP BY src_ip, sz) LEFT JOIN recur ON value = src_ip""")
def _(t):
    b = t.baseline(t.fw.where(F.col("ts") < H.instant(SPLIT)), AS_OF)
    return bare(perimeter.internal_traceroute(t.fw, t.profile, b, min_hops=2))


@query("f08_traceroute_metrics", "fw", f"WITH {_LADDERS.format(hops=2)}, {_CROSS} SELECT 'recon.internal_traceroute_sources' AS key, count(DISTINCT src_ip)::DOUBLE AS value_num FROM ranked")
def _(t):
    return values(perimeter.traceroute_metrics(t.fw, t.profile, min_hops=2))


@query("f08_traceroute_support", "fw", f"""WITH {_LADDERS.format(hops=2)}, {_CROSS}, picked AS (SELECT f.src_ip, f.dst_ip, f.proto, f.dedup_key,
  row_number() OVER (PARTITION BY f.src_ip, f.dst_ip, f.proto ORDER BY f.dedup_key) AS k FROM (SELECT DISTINCT src_ip, dst_ip, proto, dedup_key FROM fw) f
  JOIN ranked x ON x.r <= 3 AND f.src_ip = x.src_ip AND f.dst_ip = x.dst_ip AND f.proto = x.proto)
  SELECT 'recon.traceroute.' || src_ip AS signal_id, dedup_key FROM picked WHERE k <= 10""")
def _(t):
    return perimeter.traceroute_support(t.fw, t.profile, min_hops=2)


# ----- DNS


@query("n01_dns_metrics", "dns", """WITH c AS (SELECT client_ip, count(*) AS n FROM dns GROUP BY 1 ORDER BY n DESC, client_ip LIMIT 20),
  b AS (SELECT domain, count(*) AS n FROM dns WHERE blocked GROUP BY 1 ORDER BY n DESC, domain LIMIT 25)
  SELECT key, value_num::DOUBLE AS value_num FROM (SELECT 'dns.total' AS key, count(*)::DOUBLE AS value_num FROM dns
  UNION ALL SELECT 'dns.blocked', count(*) FROM dns WHERE blocked UNION ALL SELECT 'dns.block_rate', round(100.0 * count(*) FILTER (WHERE blocked) / count(*), 2) FROM dns
  UNION ALL SELECT 'dns.unique_domains', count(DISTINCT domain) FROM dns UNION ALL SELECT 'dns.clients', count(DISTINCT client_ip) FROM dns
  UNION ALL SELECT 'dns.block.' || block_reason, count(*) FROM dns WHERE blocked GROUP BY block_reason
  UNION ALL SELECT 'dns.top_blocked.' || domain, n FROM b UNION ALL SELECT 'dns.client.' || client_ip, n FROM c)""")
def _(t):
    return values(resolver.dns_metrics(t.dns, t.profile))


_NEW_NAMES = f"""fresh AS (SELECT domain, count(*) AS n FROM dns WHERE ts >= TIMESTAMP '{DNS_SPLIT}' AND NOT {BENIGN.format('domain')}
  AND domain NOT IN (SELECT domain FROM dns WHERE ts < TIMESTAMP '{DNS_SPLIT}') GROUP BY domain),
leaders AS (SELECT *, row_number() OVER (ORDER BY n DESC, domain) AS r FROM fresh)"""


def _dns_run(t):
    split = H.instant(DNS_SPLIT)
    return t.dns.where(F.col("ts") >= split), t.baseline(t.dns.where(F.col("ts") < split), DNS_SPLIT)


@query("n02_novel_domain", "dns", f"""WITH {_NEW_NAMES} SELECT 'dns.novel_domains' AS signal_id, 0::BIGINT AS severity_hint, 0.7::DOUBLE AS confidence,
  string_agg('domain:' || domain || ':', '|' ORDER BY r) FILTER (WHERE r <= 10) AS entities, count(*) AS novel_count,
  string_agg(domain || ':' || n, '|' ORDER BY r) FILTER (WHERE r <= 25) AS top_novel FROM leaders HAVING count(*) > 0""")
def _(t):
    now, b = _dns_run(t)
    return bare(resolver.novel_domain(now, t.profile, b))


_GEN = f"""gen AS (SELECT domain, n, length(label) AS len, {_ENTROPY.format(s='label')} AS entropy FROM (SELECT domain, n, {LABEL_SQL} AS label FROM (
  SELECT domain, count(*) AS n FROM dns GROUP BY domain)) WHERE {GENERATED_SQL} AND NOT {BENIGN.format('domain')}),
gens AS (SELECT *, row_number() OVER (ORDER BY round(entropy, 9) DESC, domain) AS r FROM gen)"""


@query("n03_dga_suspect", "dns", f"""WITH {_GEN} SELECT 'dns.dga_candidates' AS signal_id, 1::BIGINT AS severity_hint, 0.45::DOUBLE AS confidence, count(*) AS count FROM gens HAVING count(*) > 0""")
def _(t):
    return bare(resolver.dga_suspect(t.dns, t.profile)).drop("entities", "top")


@query("n03_generated_names", "dns", f"WITH {_GEN} SELECT domain, n AS queries, round(entropy, 6) AS entropy, len::BIGINT AS label_length FROM gens")
def _(t):
    return resolver.generated_names(t.dns, t.profile)


@query("n03_finding_metrics", "dns", f"""WITH now AS (SELECT * FROM dns WHERE ts >= TIMESTAMP '{DNS_SPLIT}'), {_NEW_NAMES}, {_GEN.replace('FROM dns', 'FROM now')},
  pay AS (SELECT domain FROM now GROUP BY domain HAVING count(*) FILTER (WHERE qtype IN ('TXT', 'NULL')) >= 20 AND count(*) FILTER (WHERE qtype IN ('TXT', 'NULL')) >= 0.5 * count(*) AND NOT {BENIGN.format('domain')})
  SELECT key, n::DOUBLE AS value_num FROM (SELECT 'dns.novel_domains' AS key, count(*) AS n FROM fresh UNION ALL SELECT 'dns.dga_candidates', count(*) FROM gens
  UNION ALL SELECT 'dns.tunnel_qtype_candidates', count(*) FROM pay) WHERE n > 0""")
def _(t):
    now, b = _dns_run(t)
    return values(resolver.finding_metrics(now, t.profile, b))


@query("n04_resolver_bypass", "fw", """WITH pairs AS (SELECT src_ip, dst_ip, count(*) AS n FROM fw WHERE dst_port IN (53, 22) AND starts_with(src_ip, '10.') AND NOT starts_with(dst_ip, '10.') GROUP BY 1, 2)
  SELECT 'dns.resolver_bypass' AS signal_id, 3::BIGINT AS severity_hint, 0.85::DOUBLE AS confidence,
  (SELECT string_agg('ip:' || v || ':client', '|' ORDER BY v) FROM (SELECT DISTINCT src_ip AS v FROM pairs)) || '|' || (SELECT string_agg('ip:' || v || ':resolver', '|' ORDER BY v) FROM (SELECT DISTINCT dst_ip AS v FROM pairs)) AS entities,
  '10.10.0.69' AS approved_resolvers, count(*) AS pairs, sum(n)::BIGINT AS lookups, string_agg(src_ip || ':' || dst_ip || ':' || n, '|' ORDER BY n DESC, src_ip, dst_ip) AS observed FROM pairs HAVING count(*) > 0""")
def _(t):
    """Traffic to another port is taken as lookups too, so that there are many pairs."""
    more = t.fw.withColumn("dst_port", F.when(F.col("dst_port") == 22, 53).otherwise(F.col("dst_port")))
    return bare(resolver.resolver_bypass(more, t.profile))


@query("n05_client_block_outlier", "dns", f"""WITH c AS (SELECT client_ip, count(*) AS total, count(*) FILTER (WHERE blocked) AS b FROM dns GROUP BY 1),
  r AS (SELECT *, 100.0 * b / total AS rate FROM c WHERE total >= 40), m AS (SELECT avg(rate) AS mean FROM r)
  SELECT 'dns.block_outlier.' || client_ip AS signal_id, 1::BIGINT AS severity_hint, 0.6::DOUBLE AS confidence, {ents('ip|client_ip|client')} AS entities, client_ip AS client,
  total AS queries, b AS blocked, round(rate, 6) AS block_rate_pct, round(mean, 6) AS network_mean_block_rate_pct, {CAVEAT_SQL} AS attribution_caveat
  FROM r, m WHERE rate >= greatest(20.0, mean * 1.3)""")
def _(t):
    return bare(resolver.client_block_outlier(t.dns, t.profile, min_queries=40, floor_pct=20.0, multiple=1.3))


@query("n06_nxdomain_outlier", "dns", f"""WITH c AS (SELECT client_ip, count(*) AS total, count(*) FILTER (WHERE block_reason = 'NXDOMAIN') AS nx FROM dns GROUP BY 1),
  r AS (SELECT *, 100.0 * nx / total AS rate FROM c WHERE total >= 40 AND nx >= 5), p AS (SELECT *, (sum(rate) OVER () - rate) / (count(*) OVER () - 1) AS peers FROM r)
  SELECT 'dns.nxdomain_outlier.' || client_ip AS signal_id, 1::BIGINT AS severity_hint, 0.5::DOUBLE AS confidence, {ents('ip|client_ip|client')} AS entities, client_ip AS client,
  total AS queries, nx AS nxdomain, round(rate, 6) AS nxdomain_rate_pct, round(peers, 6) AS peer_mean_nxdomain_rate_pct, {CAVEAT_SQL} AS attribution_caveat
  FROM p WHERE rate >= greatest(15.0, peers * 1.3)""")
def _(t):
    return bare(resolver.nxdomain_outlier(t.dns, t.profile, min_queries=40, min_nxdomain=5, multiple=1.3))


@query("n07_tunnel_suspect", "dns", f"""WITH pairs AS (SELECT client_ip, domain, count(*) AS n, regexp_extract(domain, '([^.]+\\.[^.]+)$', 1) AS apex FROM dns GROUP BY 1, 2),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY client_ip, apex ORDER BY domain) AS r FROM pairs),
  g AS (SELECT client_ip, apex, count(*) AS d, sum(n) AS q, string_agg(domain, ',' ORDER BY domain) FILTER (WHERE r <= 10) AS names FROM numbered GROUP BY 1, 2)
  SELECT 'dns.tunnel_suspect.' || client_ip || '.' || apex AS signal_id, 2::BIGINT AS severity_hint,
  round(least(0.9, 0.5 + CASE WHEN d::DOUBLE / q >= 0.95 THEN 0.2 ELSE 0 END + CASE WHEN d >= 200 THEN 0.2 ELSE 0 END), 2)::DOUBLE AS confidence,
  {ents('ip|client_ip|client', 'domain|apex|apex')} AS entities, client_ip AS client, apex, d AS distinct_subdomains, q::BIGINT AS total_queries, round(d::DOUBLE / q, 6) AS uniqueness_ratio,
  names AS sample_subdomains, {CAVEAT_SQL} AS attribution_caveat FROM g WHERE d >= 12 AND d::DOUBLE / q >= 0.6 AND NOT {BENIGN.format('apex')}""")
def _(t):
    return bare(resolver.tunnel_suspect(t.dns, t.profile, min_distinct=12, min_ratio=0.6))


@query("n08_tunnel_qtype_suspect", "dns", f"""WITH p AS (SELECT domain, count(*) FILTER (WHERE qtype IN ('TXT', 'NULL')) AS tn, count(*) AS n FROM dns GROUP BY 1),
  h AS (SELECT *, row_number() OVER (ORDER BY tn DESC, domain) AS r FROM p WHERE tn >= 10 AND tn >= 0.1 * n AND NOT {BENIGN.format('domain')})
  SELECT 'dns.tunnel_qtype_candidates' AS signal_id, 2::BIGINT AS severity_hint, 0.5::DOUBLE AS confidence, string_agg('domain:' || domain || ':', '|' ORDER BY r) FILTER (WHERE r <= 10) AS entities,
  count(*) AS count, string_agg(domain || ':' || tn || ':' || n, '|' ORDER BY r) FILTER (WHERE r <= 15) AS top FROM h HAVING count(*) > 0""")
def _(t):
    s = resolver.tunnel_qtype_suspect(t.dns, t.profile, min_count=10, min_ratio=0.1)
    return bare(s).withColumn("top", F.transform("top", lambda x: x.dropFields("ratio_pct")))


# ----- devices

_FW_RUN = f"""now_fw AS (SELECT * FROM fw WHERE ts >= TIMESTAMP '{SPLIT}'), old_fw AS (SELECT * FROM fw WHERE ts < TIMESTAMP '{SPLIT}')"""


@query("c01_novel_client", "fw dns", f"""WITH {_FW_RUN}, seen AS (SELECT src_ip AS ip FROM now_fw UNION SELECT client_ip FROM dns),
  fresh AS (SELECT ip, CASE WHEN starts_with(ip, '10.10.0.') THEN 'lan' WHEN starts_with(ip, '10.10.50.') THEN 'iot' ELSE 'dmz' END AS zone FROM seen
    WHERE starts_with(ip, '10.') AND ip NOT IN (SELECT src_ip FROM old_fw)), n AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY ip) AS r FROM fresh)
  SELECT 'net.novel_client.' || zone AS signal_id, CASE zone WHEN 'lan' THEN 1 ELSE 2 END::BIGINT AS severity_hint, 0.55::DOUBLE AS confidence,
  string_agg('ip:' || ip || ':client', '|' ORDER BY ip) FILTER (WHERE r <= 15) AS entities, zone, {_TRUST.format('zone')} AS trust, count(*) AS count,
  string_agg(CASE ip WHEN '10.10.50.7' THEN '10.10.50.7 (camera)' WHEN '10.10.0.1' THEN '10.10.0.1 (edge)' WHEN '10.10.0.69' THEN '10.10.0.69 (resolver)' ELSE ip END, ',' ORDER BY ip) FILTER (WHERE r <= 15) AS ips
  FROM n GROUP BY zone""")
def _(t):
    split = H.instant(SPLIT)
    b = t.baseline(t.fw.where(F.col("ts") < split), SPLIT)
    now = t.fw.where(F.col("ts") >= split).unionByName(t.dns)
    return bare(population.novel_client(now, t.profile, b))


@query("c01_novel_client_metrics", "fw dns", f"""WITH {_FW_RUN} SELECT 'net.novel_clients' AS key, count(*)::DOUBLE AS value_num FROM (SELECT src_ip AS ip FROM now_fw UNION SELECT client_ip FROM dns)
  WHERE starts_with(ip, '10.') AND ip NOT IN (SELECT src_ip FROM old_fw)""")
def _(t):
    split = H.instant(SPLIT)
    b = t.baseline(t.fw.where(F.col("ts") < split), SPLIT)
    return values(population.novel_client_metrics(t.fw.where(F.col("ts") >= split).unionByName(t.dns), t.profile, b))


@query("c02_novel_device_mac", "wifi", """WITH fresh AS (SELECT DISTINCT "user" AS mac FROM wifi WHERE "user" IS NOT NULL AND "user" NOT IN
    (SELECT "user" FROM wifi WHERE "user" IS NOT NULL AND ts < TIMESTAMP '2024-01-02 00:00:00')), n AS (SELECT mac, row_number() OVER (ORDER BY mac) AS r FROM fresh)
  SELECT 'net.novel_device_mac' AS signal_id, 1::BIGINT AS severity_hint, 0.5::DOUBLE AS confidence, string_agg('host:' || mac || ':client', '|' ORDER BY mac) FILTER (WHERE r <= 20) AS entities,
  count(*) AS count, string_agg(mac, ',' ORDER BY mac) FILTER (WHERE r <= 20) AS macs FROM n HAVING count(*) > 0""")
def _(t):
    split = H.instant("2024-01-02 00:00:00")
    b = t.baseline(t.wifi.where(F.col("ts") < split), "2024-01-02 00:00:00")
    return bare(population.novel_device_mac(t.wifi, b))


# ----- periodic


@query("b01_dns_beacons", "dns findings", f"""WITH {_BEACON}, {_RECUR.format(tax='c2.beacon_candidate', as_of=AS_OF)} SELECT 'beacon.dns.' || client_ip || '.' || domain AS signal_id, 2::BIGINT AS severity_hint,
  round(confidence, 6) AS confidence, {ents('ip|client_ip|client', 'domain|domain|destination')} AS entities, client_ip AS client, domain, round(interval_seconds, 6) AS interval_seconds,
  round(jitter_seconds, 6) AS jitter_seconds, round(cv, 6) AS cv, samples::BIGINT AS samples, round(span_hours, 6) AS span_hours, {CAVEAT_SQL} AS attribution_caveat,
  coalesce(prior_runs, 0) AS prior_runs FROM beacons LEFT JOIN recur ON value = domain""")
def _(t):
    b = t.baseline(t.dns.where(F.col("ts") < H.instant(DNS_SPLIT)), AS_OF)
    return bare(periodic.dns_beacons(t.dns, t.profile, b, **_BEACON_LIMITS))


_FLOW = """per AS (SELECT src_ip, dst_ip, count(*) AS samples, count(DISTINCT ts) - 1 AS gaps, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS span_s FROM fw GROUP BY 1, 2),
gapped AS (SELECT src_ip, dst_ip, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY src_ip, dst_ip ORDER BY ts))) / 1000000.0 AS gap FROM (SELECT DISTINCT src_ip, dst_ip, ts FROM fw)),
sd AS (SELECT src_ip, dst_ip, stddev_pop(gap) AS jitter FROM gapped WHERE gap > 0 GROUP BY 1, 2),
flows AS (SELECT *, span_s / gaps AS interval_seconds, jitter / (span_s / gaps) AS cv, span_s / 3600 AS span_hours FROM per JOIN sd USING (src_ip, dst_ip)
  WHERE samples >= 4 AND gaps >= 3 AND span_s >= 10800 AND starts_with(src_ip, '10.') AND NOT starts_with(dst_ip, '10.')),
hits AS (SELECT *, 0.45 + 0.5 * (0.6 * greatest(0, 1 - cv / 0.6) + 0.4 * least(1, gaps / 60.0)) AS c FROM flows WHERE cv <= 0.6 AND interval_seconds BETWEEN 30 AND 1000000000)"""
_FLOW_LIMITS = {"min_samples": 4, "max_cv": 0.6, "max_interval_s": 1e9}


def _as_flow(t):
    return t.fw.withColumn("kind", F.lit("flow"))


@query("b02_flow_beacons", "fw", f"""WITH {_FLOW} SELECT 'beacon.flow.' || src_ip || '.' || dst_ip AS signal_id, 3::BIGINT AS severity_hint, round(least(0.95, c + 0.1), 6) AS confidence,
  {ents('ip|src_ip|source', 'ip|dst_ip|destination')} AS entities, src_ip AS src, dst_ip AS dst, round(interval_seconds, 6) AS interval_seconds, round(jitter, 6) AS jitter_seconds, round(cv, 6) AS cv,
  samples::BIGINT AS samples, round(span_hours, 6) AS span_hours, '' AS attribution_caveat FROM hits""")
def _(t):
    return bare(periodic.flow_beacons(_as_flow(t), t.profile, **_FLOW_LIMITS))


@query("b03_beacon_metrics", "fw", f"WITH {_FLOW} SELECT 'beacon.candidates' AS key, count(*)::DOUBLE AS value_num FROM hits")
def _(t):
    return values(periodic.beacon_metrics(_as_flow(t), t.profile, **_FLOW_LIMITS))


# ----- logons


@query("u01_vpn_instability", "wifi", f"""WITH n AS (SELECT count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-06 00:00:00') AS now, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-06 00:00:00') AS old
  FROM wifi WHERE program = 'VPNSERVER1') SELECT 'auth.vpn_restart_frequency' AS signal_id, 1::BIGINT AS severity_hint, 0.4::DOUBLE AS confidence, 'host:vpn-daemon:service' AS entities,
  now AS events_this_run, old::DOUBLE AS prior_run_events FROM n WHERE old > 0 AND now >= 3 * old AND now >= 30""")
def _(t):
    split = H.instant("2024-01-06 00:00:00")
    old = t.wifi.where((F.col("ts") < split) & (F.col("program") == "VPNSERVER1"))
    prior = old.agg(F.count("*").cast("double").alias("prior")).select(F.lit("auth.vpn_events").alias("key"), "prior")
    return bare(logons.vpn_instability(t.wifi.where(F.col("ts") >= split), t.baseline(old, AS_OF, prior)))


@query("u02_auth_metrics", "wifi win ssh web", """SELECT key, n::DOUBLE AS value_num FROM (SELECT 'auth.vpn_events' AS key, count(*) AS n FROM wifi WHERE program = 'VPNSERVER1'
  UNION ALL SELECT 'auth.deauth_total', count(*) FROM wifi WHERE action = 'deauth' UNION ALL SELECT 'auth.deauth_distinct_devices', count(DISTINCT "user") FROM wifi WHERE action = 'deauth'
  UNION ALL SELECT 'auth.windows_logon_events', count(*) FROM win UNION ALL SELECT 'auth.ssh_events', count(*) FROM ssh UNION ALL SELECT 'auth.router_admin_events', count(*) FROM web)""")
def _(t):
    """Also the Windows, SSH and router logon counts (u05, u10, u14)."""
    return values(logons.auth_metrics(t.wifi.unionByName(t.win).unionByName(t.ssh).unionByName(t.web)))


@query("u03_deauth_outlier", "wifi", """WITH c AS (SELECT "user" AS mac, count(*) AS n FROM wifi WHERE action = 'deauth' GROUP BY 1), top AS (SELECT mac, n FROM c ORDER BY n DESC, mac LIMIT 1),
  m AS (SELECT median(n) AS med FROM c WHERE mac <> (SELECT mac FROM top)) SELECT 'auth.deauth_outlier.' || mac AS signal_id, 1::BIGINT AS severity_hint, 0.5::DOUBLE AS confidence,
  'host:' || mac || ':client' AS entities, mac, n AS deauth_count, round(med, 6) AS peer_median_deauths, (SELECT count(*) FROM c) AS distinct_devices_this_run
  FROM top, m WHERE (SELECT sum(n) FROM c) >= 20 AND n >= greatest(10, (med + 1) * 1.1)""")
def _(t):
    return bare(logons.deauth_outlier(t.wifi, multiple=1.1))


@query("u04_mass_deauth_burst", "wifi", f"""WITH {_WINDOW}, macs AS (SELECT DISTINCT m FROM seen, best WHERE s BETWEEN e - 3600 AND e), num AS (SELECT m, row_number() OVER (ORDER BY m) AS r FROM macs),
  st AS (SELECT make_timestamp(min(s) * 1000000) AS w FROM seen, best WHERE s BETWEEN e - 3600 AND e)
  SELECT 'auth.mass_deauth.' || strftime(w, '%Y%m%dT%H%M%S') AS signal_id, 2::BIGINT AS severity_hint, 0.55::DOUBLE AS confidence,
  (SELECT string_agg('host:' || m || ':client', '|' ORDER BY m) FROM num WHERE r <= 10) AS entities, w AS window_start, 60::BIGINT AS window_minutes, n AS distinct_devices,
  (SELECT string_agg(m, ',' ORDER BY m) FROM num WHERE r <= 20) AS macs FROM best, st WHERE n >= 6""")
def _(t):
    return bare(logons.mass_deauth_burst(t.wifi, window_s=3600))


def _accounts_sql(view: str, signal: str, actions: str, split: str) -> str:
    return f"""WITH fresh AS (SELECT DISTINCT "user" AS a FROM {view} WHERE action IN ({actions}) AND ts >= TIMESTAMP '{split}' AND "user" NOT IN
      (SELECT "user" FROM {view} WHERE ts < TIMESTAMP '{split}')), n AS (SELECT a, row_number() OVER (ORDER BY a) AS r FROM fresh)
      SELECT '{signal}' AS signal_id, 2::BIGINT AS severity_hint, 0.55::DOUBLE AS confidence, string_agg('user:' || a || ':account', '|' ORDER BY a) FILTER (WHERE r <= 10) AS entities,
      count(*) AS count, string_agg(a, ',' ORDER BY a) FILTER (WHERE r <= 20) AS accounts FROM n HAVING count(*) > 0"""


def _account_run(t, view, split):
    at = H.instant(split)
    return view.where(F.col("ts") >= at), t.baseline(view.where(F.col("ts") < at), split)


@query("u06_windows_new_account", "win", _accounts_sql("win", "auth.windows_new_account", "'logon_success','logon_failed','privileged','explicit_creds','lockout'", "1995-01-05 00:00:00"))
def _(t):
    now, b = _account_run(t, t.win, "1995-01-05 00:00:00")
    return bare(logons.windows_new_account(now, b))


@query("u07_windows_external_logon", "win", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY ts DESC, id DESC) AS r FROM win WHERE action = 'logon_success' AND proto IN ('network', 'rdp', 'net_clear')
  AND NOT starts_with(src_ip, '10.')) SELECT 'auth.windows_external_logon.' || src_ip AS signal_id, 3::BIGINT AS severity_hint, 0.7::DOUBLE AS confidence,
  'ip:' || src_ip || ':source|user:' || "user" || ':account' AS entities, src_ip, "user" AS account, proto AS logon_type, device FROM o WHERE r = 1""")
def _(t):
    return bare(logons.windows_external_logon(t.win, t.profile))


@query("u08_windows_logon_failure_burst", "win", """WITH f AS (SELECT "user" AS a, count(*) AS n FROM win WHERE action = 'logon_failed' GROUP BY 1), l AS (SELECT a, n FROM f ORDER BY n DESC, a LIMIT 10)
  SELECT 'auth.windows_logon_failure_burst' AS signal_id, 2::BIGINT AS severity_hint, 0.5::DOUBLE AS confidence, string_agg('user:' || a || ':account', '|' ORDER BY n DESC, a) AS entities,
  (SELECT sum(n)::BIGINT FROM f) AS failed_logons, string_agg(a || ':' || n, '|' ORDER BY n DESC, a) AS by_account FROM l HAVING (SELECT sum(n) FROM f) >= 5""")
def _(t):
    return bare(logons.windows_logon_failure_burst(t.win))


@query("u09_malware_detection", "ids", """WITH l AS (SELECT * FROM ids ORDER BY ts DESC, id LIMIT 5) SELECT 'endpoint.defender_detection' AS signal_id, 3::BIGINT AS severity_hint, 0.75::DOUBLE AS confidence,
  (SELECT string_agg('host:' || device || ':host', '|' ORDER BY device) FROM (SELECT DISTINCT device FROM ids)) AS entities, (SELECT count(*) FROM ids) AS count,
  (SELECT string_agg(device, ',' ORDER BY device) FROM (SELECT DISTINCT device FROM ids)) AS device_ids, string_agg(message, ',' ORDER BY ts DESC, id) AS messages FROM l""")
def _(t):
    return bare(logons.malware_detection(t.ids))


@query("u11_ssh_new_account", "ssh", _accounts_sql("ssh", "auth.ssh_new_account", "'ssh_accepted'", "1995-01-05 00:00:00"))
def _(t):
    now, b = _account_run(t, t.ssh, "1995-01-05 00:00:00")
    return bare(logons.ssh_new_account(now, b))


@query("u12_ssh_external_logon", "ssh", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY ts DESC, id DESC) AS r FROM ssh WHERE action = 'ssh_accepted' AND NOT starts_with(src_ip, '10.'))
  SELECT 'auth.ssh_external_logon.' || src_ip AS signal_id, 3::BIGINT AS severity_hint, 0.7::DOUBLE AS confidence, 'ip:' || src_ip || ':source|user:' || "user" || ':account' AS entities,
  src_ip, "user" AS account, proto AS method, device FROM o WHERE r = 1""")
def _(t):
    return bare(logons.ssh_external_logon(t.ssh, t.profile))


@query("u13_ssh_failure_burst", "ssh", """WITH f AS (SELECT * FROM ssh WHERE action IN ('ssh_failed', 'ssh_invalid')), s AS (SELECT src_ip AS v, count(*) AS n FROM f GROUP BY 1 ORDER BY n DESC, v LIMIT 10),
  a AS (SELECT "user" AS v, count(*) AS n FROM f GROUP BY 1 ORDER BY n DESC, v LIMIT 10) SELECT 'auth.ssh_failure_burst' AS signal_id, 2::BIGINT AS severity_hint, 0.6::DOUBLE AS confidence,
  string_agg('ip:' || v || ':source', '|' ORDER BY n DESC, v) AS entities, (SELECT count(*) FROM f) AS failed_attempts, string_agg(v || ':' || n, '|' ORDER BY n DESC, v) AS by_source,
  (SELECT string_agg(v || ':' || n, '|' ORDER BY n DESC, v) FROM a) AS by_account FROM s HAVING (SELECT count(*) FROM f) >= 5""")
def _(t):
    return bare(logons.ssh_failure_burst(t.ssh))


@query("u14_router_admin_external_login", "web", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY ts DESC, id DESC) AS r FROM web WHERE action = 'web_login_success' AND NOT starts_with(src_ip, '10.'))
  SELECT 'auth.router_admin_external_login.' || src_ip AS signal_id, 3::BIGINT AS severity_hint, 0.7::DOUBLE AS confidence, 'ip:' || src_ip || ':source|host:' || device || ':target' AS entities,
  src_ip, "user" AS account, device FROM o WHERE r = 1""")
def _(t):
    return bare(logons.router_admin_external_login(t.web, t.profile))


@query("u15_router_admin_failure_burst", "web", """WITH f AS (SELECT src_ip AS v, count(*) AS n FROM web WHERE action = 'web_login_failed' GROUP BY 1), s AS (SELECT * FROM f ORDER BY n DESC, v LIMIT 10)
  SELECT 'auth.router_admin_failure_burst' AS signal_id, 2::BIGINT AS severity_hint, 0.6::DOUBLE AS confidence, string_agg('ip:' || v || ':source', '|' ORDER BY n DESC, v) AS entities,
  (SELECT sum(n)::BIGINT FROM f) AS failed_attempts, string_agg(v || ':' || n, '|' ORDER BY n DESC, v) AS by_source FROM s HAVING (SELECT sum(n) FROM f) >= 5""")
def _(t):
    return bare(logons.router_admin_failure_burst(t.web))


# ----- zones


@query("g01_zone_metrics", "fw dns", """WITH z AS (SELECT unnest(['lan', 'iot', 'dmz']) AS zone) SELECT key, n::DOUBLE AS value_num FROM (
  SELECT 'zone.' || zone || '.dns' AS key, (SELECT count(*) FROM dns WHERE src_zone = zone) AS n FROM z
  UNION ALL SELECT 'zone.' || zone || '.fw', (SELECT count(*) FROM fw WHERE src_zone = zone OR dst_zone = zone) FROM z
  UNION ALL SELECT 'zone.' || zone || '.dns_clients', (SELECT count(DISTINCT client_ip) FROM dns WHERE src_zone = zone) FROM z
  UNION ALL SELECT 'zone.' || zone || '.fw_clients', (SELECT count(*) FROM (SELECT src_ip FROM fw WHERE src_zone = zone UNION SELECT dst_ip FROM fw WHERE dst_zone = zone)) FROM z)""")
def _(t):
    return values(segments.zone_metrics(t.fw.unionByName(t.dns), t.profile))


@query("g02_unexpected_egress", "dns", f"""WITH u AS (SELECT domain, count(*) AS n FROM dns WHERE src_zone = 'iot' AND NOT (domain = 'example.com' OR domain LIKE '%.example.com') AND NOT {BENIGN.format('domain')} GROUP BY 1),
  r AS (SELECT *, row_number() OVER (ORDER BY n DESC, domain) AS r FROM u) SELECT 'zone.iot.unexpected_egress' AS signal_id, 2::BIGINT AS severity_hint, 0.6::DOUBLE AS confidence,
  string_agg('domain:' || domain || ':', '|' ORDER BY r) FILTER (WHERE r <= 10) AS entities, 'iot' AS zone, 'untrusted' AS trust, count(*) AS count,
  string_agg(domain || ':' || n, '|' ORDER BY r) FILTER (WHERE r <= 20) AS unexpected FROM r HAVING count(*) > 0""")
def _(t):
    return bare(segments.unexpected_egress(t.dns, t.profile)).drop("attribution_caveat")


@query("g03_inbound_accepted", "fw", """WITH a AS (SELECT dst_zone AS zone, src_ip, dst_port, count(*) AS n, dst_port IN (22, 23, 445, 3389) AS w FROM fw WHERE action = 'accept' AND dst_zone IN ('iot', 'dmz')
    AND NOT starts_with(src_ip, '10.') GROUP BY 1, 2, 3), k AS (SELECT * FROM a WHERE w OR NOT (SELECT bool_or(w) FROM a x WHERE x.zone = a.zone)),
  r AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY n DESC, src_ip, dst_port) AS r FROM k)
  SELECT 'zone.' || zone || '.inbound_accepted' AS signal_id, 3::BIGINT AS severity_hint, 0.8::DOUBLE AS confidence, string_agg('ip:' || src_ip || ':source', '|' ORDER BY r) FILTER (WHERE r <= 8) || '|' ||
  string_agg('port:' || dst_port || ':destination', '|' ORDER BY r) FILTER (WHERE r <= 8) AS entities, zone, CASE zone WHEN 'iot' THEN 'untrusted' ELSE 'semi-trusted' END AS trust, false AS novel_sources_only,
  string_agg(src_ip || ':' || dst_port || ':' || n, '|' ORDER BY r) FILTER (WHERE r <= 20) AS accepted FROM r GROUP BY zone""")
def _(t):
    return bare(segments.inbound_accepted(t.fw, t.profile))


_PARTS = """z AS (SELECT unnest(['lan', 'iot', 'dmz']) AS zone), d AS (SELECT unnest(['night', 'morning', 'afternoon', 'evening']) AS part),
  e AS (SELECT src_zone AS zone, ts FROM fw UNION ALL SELECT dst_zone, ts FROM fw WHERE dst_zone <> src_zone),
  c AS (SELECT zone, ['night','morning','afternoon','evening'][CAST(floor(hour((date_trunc('hour', ts) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') / 6) AS INTEGER) + 1] AS part, count(*) AS n FROM e GROUP BY 1, 2),
  counts AS (SELECT zone, part, 'zone.' || zone || '.daypart.' || part AS key, coalesce(n, 0) AS n FROM z CROSS JOIN d LEFT JOIN c USING (zone, part))"""


@query("g04_zone_daypart_metrics", "fw", f"WITH {_PARTS} SELECT key, n::DOUBLE AS value_num FROM counts")
def _(t):
    return values(segments.zone_daypart_metrics(t.fw, t.profile))


@query("g04_time_of_day_anomaly", "fw metrics", f"""WITH {_PARTS}, h AS (SELECT key, count(*) AS p, avg(value_num) AS m FROM metrics WHERE value_num IS NOT NULL AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY key)
  SELECT 'zone.' || zone || '.daypart_anomaly.' || part AS signal_id, CASE zone WHEN 'lan' THEN 1 ELSE 2 END::BIGINT AS severity_hint, 0.5::DOUBLE AS confidence, 'host:' || zone || ':segment' AS entities,
  zone, part AS daypart, n AS events_this_run, round(m, 6) AS historical_mean, p AS history_days_observed, 'America/New_York' AS site_timezone FROM counts JOIN h USING (key)
  WHERE p >= 5 AND m <= 5 AND n >= 20 AND n >= greatest(m, 1.0) * 4""")
def _(t):
    return bare(segments.time_of_day_anomaly(t.fw, t.profile, t.metrics, AS_OF))


@query("g05_nat_notes", "dns", f"SELECT DISTINCT client_ip AS gateway, {CAVEAT_SQL} AS note FROM dns WHERE client_ip IN ('10.10.0.10', '10.10.0.4')")
def _(t):
    notes = segments.nat_notes(t.spark, t.profile)
    return notes.join(t.dns.select(F.col("client_ip").alias("gateway")), "gateway", "left_semi")


# ----- volume

def _egress(t):
    # Every accepted row of the tables comes from outside; seen from the other side it is outbound.
    swapped = t.fw.withColumns({"src_ip": F.col("dst_ip"), "dst_ip": F.col("src_ip")})
    return swapped


_EGRESS = """pairs AS (SELECT dst_ip AS src_ip, src_ip AS dst_ip, sum(pkt_len)::BIGINT AS bytes, count(*) AS hits FROM fw WHERE action = 'accept' AND starts_with(dst_ip, '10.') AND NOT starts_with(src_ip, '10.') GROUP BY 1, 2)"""


@query("v01_volume_metrics", "fw", f"WITH {_EGRESS} SELECT 'fw.bytes.outbound_accepted' AS key, coalesce(sum(bytes), 0)::DOUBLE AS value_num FROM pairs")
def _(t):
    return values(volume.volume_metrics(_egress(t), t.profile))


@query("v02_volume_outlier", "fw", f"""WITH {_EGRESS}, s AS (SELECT src_ip, sum(bytes)::BIGINT AS b FROM pairs GROUP BY 1), p AS (SELECT *, (sum(b) OVER () - b)::DOUBLE / (count(*) OVER () - 1) AS m, count(*) OVER () AS k FROM s)
  SELECT 'data.volume_outlier.' || src_ip AS signal_id, 2::BIGINT AS severity_hint, 0.5::DOUBLE AS confidence, 'ip:' || src_ip || ':source' AS entities, src_ip AS src, b AS outbound_accepted_bytes,
  round(m, 6) AS network_mean_bytes, round(b / m, 6) AS multiple_of_mean, '' AS attribution_caveat FROM p WHERE k >= 3 AND b >= greatest(50000.0, m * 1.1)""")
def _(t):
    return bare(volume.volume_outlier(_egress(t), t.profile, floor_bytes=50000, multiple=1.1))


@query("v03_large_transfer", "fw", f"""WITH {_EGRESS}, top AS (SELECT * FROM pairs WHERE bytes >= 1000), x AS (SELECT *, dst_ip NOT IN (SELECT dst_ip FROM fw WHERE ts < TIMESTAMP '1995-06-01 00:00:00') AS new FROM top)
  SELECT 'data.large_transfer.' || src_ip || '.' || dst_ip AS signal_id, CASE WHEN new THEN 2 ELSE 1 END::BIGINT AS severity_hint, CASE WHEN new THEN 0.6 ELSE 0.45 END::DOUBLE AS confidence,
  'ip:' || src_ip || ':source|ip:' || dst_ip || ':destination' AS entities, src_ip AS src, dst_ip AS dst, bytes, hits, new AS destination_is_novel, '' AS attribution_caveat FROM x""")
def _(t):
    b = t.baseline(_egress(t).where(F.col("ts") < H.instant("1995-06-01 00:00:00")), AS_OF)
    return bare(volume.large_transfer(_egress(t), t.profile, b, floor_bytes=1000))


# ----- correlation


@query("x01_shared_host_metrics", "fw dns", "SELECT 'corr.dns_and_fw_hosts' AS key, count(DISTINCT src_ip)::DOUBLE AS value_num FROM fw WHERE starts_with(src_ip, '10.') AND src_ip IN (SELECT client_ip FROM dns)")
def _(t):
    return values(correlate.shared_host_metrics(t.events, t.profile))


@query("x02_watchlist_hit", "fw dns watchlist", f"""WITH {_WATCH} SELECT 'corr.watchlist.' || entity_type || '.' || entity_value AS signal_id, 2::BIGINT AS severity_hint, 0.7::DOUBLE AS confidence,
  entity_type || ':' || entity_value || ':' AS entities, entity_value AS entity, entity_type, n AS events_this_period, reason AS watch_reason, coalesce(strftime(expires_at, '%Y-%m-%d'), 'never') AS watch_expires FROM hits""")
def _(t):
    return bare(correlate.watchlist_hit(t.fw.unionByName(t.dns), t.baseline(t.fw, AS_OF)))


@query("x03_internal_scan", "fw", f"""SELECT 'corr.internal_scan.' || src_ip AS signal_id, 3::BIGINT AS severity_hint, 0.65::DOUBLE AS confidence, 'ip:' || src_ip || ':source' AS entities, src_ip AS src, hits,
  ports AS distinct_destination_ports, round(h, 2) AS duration_hours FROM (SELECT src_ip, count(*) AS hits, count(DISTINCT dst_port) AS ports, {HOURS} AS h FROM fw WHERE starts_with(src_ip, '10.') GROUP BY 1) WHERE ports >= 8 AND hits >= 50""")
def _(t):
    return bare(correlate.internal_scan(t.fw, t.profile, min_ports=8))


# ----- indicators

_ACTIVITY = f"""{IP_MATCHES}, grouped AS (SELECT src_ip, dst_ip, dst_port, action, count(*) AS hits, min(ts) AS a, max(ts) AS b FROM fw GROUP BY 1, 2, 3, 4),
act AS (SELECT kind, indicator, src_ip, dst_ip, dst_port, action, hits, a, b, bool_or(inb) AS inb FROM (
  SELECT h.kind, h.indicator, g.*, true AS inb FROM grouped g JOIN ip_hits h ON g.src_ip = h.value UNION ALL
  SELECT h.kind, h.indicator, g.*, false FROM grouped g JOIN ip_hits h ON g.dst_ip = h.value) GROUP BY ALL),
sums AS (SELECT kind, indicator, coalesce(sum(hits) FILTER (WHERE inb AND ok), 0)::BIGINT AS ia, coalesce(sum(hits) FILTER (WHERE inb AND NOT ok), 0)::BIGINT AS ib,
  coalesce(sum(hits) FILTER (WHERE NOT inb AND ok), 0)::BIGINT AS oa, coalesce(sum(hits) FILTER (WHERE NOT inb AND NOT ok), 0)::BIGINT AS ob, bool_or(NOT inb) AS outb, min(a) AS a, max(b) AS b
  FROM (SELECT *, action NOT IN ('drop', 'reject', 'deny', 'block') AS ok FROM act) GROUP BY 1, 2),
ports AS (SELECT kind, indicator, string_agg(dst_port::VARCHAR, ',' ORDER BY r) AS dst_ports FROM (SELECT kind, indicator, dst_port, row_number() OVER (PARTITION BY kind, indicator ORDER BY sum(hits) DESC, dst_port) AS r
  FROM act GROUP BY 1, 2, 3) WHERE r <= 10 GROUP BY 1, 2),
vals AS (SELECT kind, indicator, value, row_number() OVER (PARTITION BY kind, indicator ORDER BY value) AS r FROM (SELECT DISTINCT kind, indicator, value FROM ip_hits)),
locals AS (SELECT kind, indicator, ip, row_number() OVER (PARTITION BY kind, indicator ORDER BY ip) AS r FROM (SELECT DISTINCT a.kind, a.indicator, CASE WHEN inb THEN dst_ip ELSE src_ip END AS ip FROM act a) l
  WHERE NOT EXISTS (SELECT 1 FROM ip_hits h WHERE h.kind = l.kind AND h.indicator = l.indicator AND h.value = l.ip))"""


@query("i01_ip_match", "fw iocs", f"""WITH {_ACTIVITY} SELECT 'ioc.' || s.kind || '.' || s.indicator AS signal_id, CASE WHEN NOT outb AND ia = 0 THEN least(1, i.severity) ELSE i.severity END::BIGINT AS severity_hint,
  CASE i.tier WHEN 'T1' THEN 0.9 WHEN 'T2' THEN 0.7 WHEN 'T3' THEN 0.5 ELSE 0.2 END::DOUBLE AS confidence, s.indicator, i.tier,
  (SELECT string_agg(value, ',' ORDER BY value) FROM vals v WHERE v.kind = s.kind AND v.indicator = s.indicator AND r <= 10) AS matched, ia AS inbound_accepted, ib AS inbound_blocked, oa AS outbound_allowed,
  ob AS outbound_blocked, dst_ports, coalesce((SELECT string_agg(ip, ',' ORDER BY ip) FROM locals l WHERE l.kind = s.kind AND l.indicator = s.indicator AND r <= 10), '') AS local_ips, a AS first_seen, b AS last_seen,
  NOT outb AND ia = 0 AND i.severity > 1 AS severity_capped FROM sums s JOIN iocs i ON i.kind = s.kind AND i.value = s.indicator LEFT JOIN ports p ON p.kind = s.kind AND p.indicator = s.indicator""")
def _(t):
    s = indicators.ip_match(t.fw, t.indicators, t.profile)
    return s.select(
        "signal_id", "severity_hint", "confidence", "indicator", "tier", "matched", "inbound_accepted", "inbound_blocked", "outbound_allowed", "outbound_blocked",
        "dst_ports", F.transform("local_addresses", lambda x: x["ip"]).alias("local_ips"), "first_seen", "last_seen", "severity_capped",
    )


@query("i02_domain_match", "dns iocs", f"""WITH {NAME_MATCHES}, act AS (SELECT h.kind, h.indicator, d.client_ip, d.domain, d.blocked, d.ts FROM dns d JOIN name_hits h ON d.domain = h.value),
  m AS (SELECT kind, indicator, string_agg(value, ',' ORDER BY value) AS matched FROM (SELECT kind, indicator, value, row_number() OVER (PARTITION BY kind, indicator ORDER BY value) AS r FROM (SELECT DISTINCT kind, indicator, domain AS value FROM act)) WHERE r <= 10 GROUP BY 1, 2),
  c AS (SELECT kind, indicator, string_agg(value, ',' ORDER BY value) AS clients FROM (SELECT kind, indicator, value, row_number() OVER (PARTITION BY kind, indicator ORDER BY value) AS r FROM (SELECT DISTINCT kind, indicator, client_ip AS value FROM act)) WHERE r <= 10 GROUP BY 1, 2)
  SELECT 'ioc.' || a.kind || '.' || a.indicator AS signal_id, any_value(i.severity)::BIGINT AS severity_hint, any_value(i.tier) AS tier, count(*) AS queries, count(*) FILTER (WHERE blocked) AS blocked_by_resolver,
  any_value(matched) AS matched, any_value(clients) AS clients, min(ts) AS first_seen, max(ts) AS last_seen FROM act a JOIN iocs i ON i.kind = a.kind AND i.value = a.indicator
  JOIN m ON m.kind = a.kind AND m.indicator = a.indicator JOIN c ON c.kind = a.kind AND c.indicator = a.indicator GROUP BY a.kind, a.indicator""")
def _(t):
    return indicators.domain_match(t.dns, t.indicators).select(
        "signal_id", "severity_hint", "tier", "queries", "blocked_by_resolver", "matched", "clients", "first_seen", "last_seen"
    )


@query("i03_indicator_metrics", "fw dns iocs", f"""WITH {IP_MATCHES}, {NAME_MATCHES} SELECT 'ioc.indicators' AS key, count(*)::DOUBLE AS value_num FROM iocs
  UNION ALL SELECT 'ioc.matched', count(*)::DOUBLE FROM (SELECT kind, indicator FROM ip_hits UNION SELECT kind, indicator FROM name_hits)""")
def _(t):
    return values(indicators.indicator_metrics(t.fw.unionByName(t.dns), t.indicators))


# ----- trends

_NOW = f"""cur AS (SELECT 'fw.drops' AS key, count(*) FILTER (WHERE action = 'drop' AND ts >= TIMESTAMP '{SPLIT}') AS now, count(*) FILTER (WHERE action = 'drop' AND ts < TIMESTAMP '{SPLIT}') AS before FROM fw
  UNION ALL SELECT 'fw.unique_sources', count(DISTINCT src_ip) FILTER (WHERE ts >= TIMESTAMP '{SPLIT}'), count(DISTINCT src_ip) FILTER (WHERE ts < TIMESTAMP '{SPLIT}') FROM fw
  UNION ALL SELECT 'dns.total', count(*), count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-02 00:00:00') FROM dns
  UNION ALL SELECT 'dns.blocked', count(*) FILTER (WHERE blocked), count(*) FILTER (WHERE blocked AND ts < TIMESTAMP '2024-01-02 00:00:00') FROM dns
  UNION ALL SELECT 'dns.unique_domains', count(DISTINCT domain), count(DISTINCT domain) FILTER (WHERE ts < TIMESTAMP '2024-01-02 00:00:00') FROM dns),
  ch AS (SELECT key, now::DOUBLE AS now, before::DOUBLE AS before, now::DOUBLE / before AS ratio, (now - before)::DOUBLE / before * 100 AS pct FROM cur WHERE before > 0)"""


def _trend_run(t):
    split, dns_split = H.instant(SPLIT), H.instant("2024-01-02 00:00:00")
    old = t.fw.where(F.col("ts") < split).unionByName(t.dns.where(F.col("ts") < dns_split))
    now = t.fw.where(F.col("ts") >= split).unionByName(t.dns)
    prior = trends.current_values(old).select("key", F.col("now").alias("prior"))
    return now, t.baseline(old, AS_OF, prior)


@query("t01_trend_metrics", "fw dns", f"WITH {_NOW} SELECT 'trend.' || key || '.change_pct' AS key, round(pct, 6) AS value_num FROM ch UNION ALL SELECT 'trend.baseline_available', 1.0::DOUBLE")
def _(t):
    now, b = _trend_run(t)
    return values(trends.trend_metrics(now, b))


@query("t02_magnitude_shift", "fw dns", f"""WITH {_NOW} SELECT 'trend.anomaly.' || key AS signal_id, 1::BIGINT AS severity_hint, 0.5::DOUBLE AS confidence, 'host:pipeline:' AS entities, key AS metric,
  before AS prior, now AS current, round(ratio, 6) AS ratio FROM ch WHERE ratio >= 10 OR ratio <= 0.1""")
def _(t):
    now, b = _trend_run(t)
    return bare(trends.magnitude_shift(now, b))


@query("t03_change_notes", "fw dns", f"""WITH {_NOW} SELECT key, CASE key WHEN 'fw.drops' THEN 'firewall DROPs' WHEN 'fw.unique_sources' THEN 'unique external sources' WHEN 'dns.total' THEN 'DNS queries'
  WHEN 'dns.blocked' THEN 'blocked DNS queries' ELSE 'unique domains' END || printf(' changed %+.0f%% versus the prior run (%.0f -> %.0f)', pct, before, now) AS note FROM ch WHERE ratio < 10 AND ratio > 0.1 AND abs(pct) >= 20""")
def _(t):
    now, b = _trend_run(t)
    return trends.change_notes(now, b, material_pct=20.0)


@query("h01_has_baseline", "metrics", f"""WITH {_RUNS} SELECT (SELECT count(*) FROM metrics WHERE run_id = {_LATEST} AND value_num IS NOT NULL) > 0 AS has_baseline""")
def _(t):
    prior = H.prior_metrics(_runs(t), t.metrics, "run3")
    return t.spark.range(1).select(prior.select("key").exists().alias("has_baseline"))
