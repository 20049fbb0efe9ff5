"""The daily analysis: which detectors and metrics run on a run's events, and how to run them all."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake.operators import (
    cloud,
    correlate,
    indicators,
    logons,
    perimeter,
    periodic,
    population,
    resolver,
    segments,
    trends,
    volume,
)
from sentrylake.operators import query as q
from sentrylake.operators.history import Baseline
from sentrylake.operators.metrics import all_of
from sentrylake.operators.signals import signal_rows
from sentrylake.profile import Profile
from sentrylake.schema import CANARY_SOURCE, SIGNAL_SCHEMA
from sentrylake.session import materialize


@dataclass(frozen=True)
class Context:
    """What a detector may look at."""

    events: DataFrame
    profile: Profile
    baseline: Baseline | None = None
    indicators: DataFrame | None = None


@dataclass(frozen=True)
class Detector:
    """A named function from a context to signals, with the event kinds and sources it needs."""

    name: str
    run: Callable[[Context], DataFrame]
    kinds: frozenset[str]
    sources: frozenset[str] = frozenset()
    needs_baseline: bool = False
    needs_indicators: bool = False

    def applicable(self, kinds: Iterable[str], sources: Iterable[str] = ()) -> bool:
        if self.kinds and not self.kinds & set(kinds):
            return False
        return not self.sources or bool(self.sources & set(sources))


def _d(name, run, kinds, **more) -> Detector:
    return Detector(name, run, frozenset(kinds.split()), **more)


_CLOUD = {"sources": frozenset({cloud.AUDIT, cloud.FINDINGS})}

DETECTORS: tuple[Detector, ...] = (
    _d("volume_spike", lambda c: perimeter.volume_spike(c.events), "firewall"),
    _d("mass_sweep", lambda c: perimeter.mass_sweep(c.events), "firewall"),
    _d("persistent_prober", lambda c: perimeter.persistent_prober(c.events, c.profile, c.baseline), "firewall"),
    _d("stepped_ttl", lambda c: perimeter.stepped_ttl(c.events), "firewall"),
    _d("internal_traceroute", lambda c: perimeter.internal_traceroute(c.events, c.profile, c.baseline), "firewall"),
    _d("novel_domain", lambda c: resolver.novel_domain(c.events, c.profile, c.baseline), "dns", needs_baseline=True),
    _d("dga_suspect", lambda c: resolver.dga_suspect(c.events, c.profile), "dns"),
    _d("resolver_bypass", lambda c: resolver.resolver_bypass(c.events, c.profile), "dns"),
    _d("client_block_outlier", lambda c: resolver.client_block_outlier(c.events, c.profile), "dns"),
    _d("nxdomain_outlier", lambda c: resolver.nxdomain_outlier(c.events, c.profile), "dns"),
    _d("tunnel_suspect", lambda c: resolver.tunnel_suspect(c.events, c.profile), "dns"),
    _d("tunnel_qtype_suspect", lambda c: resolver.tunnel_qtype_suspect(c.events, c.profile), "dns"),
    _d("novel_client", lambda c: population.novel_client(c.events, c.profile, c.baseline), "dns firewall system auth", needs_baseline=True),
    _d("novel_device_mac", lambda c: population.novel_device_mac(c.events, c.baseline), "dns firewall system auth", needs_baseline=True),
    _d("dns_beacons", lambda c: periodic.dns_beacons(c.events, c.profile, c.baseline), "dns flow firewall"),
    _d("flow_beacons", lambda c: periodic.flow_beacons(c.events, c.profile), "dns flow firewall"),
    _d("vpn_instability", lambda c: logons.vpn_instability(c.events, c.baseline), "auth ids", needs_baseline=True),
    _d("deauth_outlier", lambda c: logons.deauth_outlier(c.events), "auth ids"),
    _d("mass_deauth_burst", lambda c: logons.mass_deauth_burst(c.events), "auth ids"),
    _d("windows_new_account", lambda c: logons.windows_new_account(c.events, c.baseline), "auth ids", needs_baseline=True),
    _d("windows_external_logon", lambda c: logons.windows_external_logon(c.events, c.profile), "auth ids"),
    _d("windows_logon_failure_burst", lambda c: logons.windows_logon_failure_burst(c.events), "auth ids"),
    _d("malware_detection", lambda c: logons.malware_detection(c.events), "auth ids"),
    _d("ssh_new_account", lambda c: logons.ssh_new_account(c.events, c.baseline), "auth ids", needs_baseline=True),
    _d("ssh_external_logon", lambda c: logons.ssh_external_logon(c.events, c.profile), "auth ids"),
    _d("ssh_failure_burst", lambda c: logons.ssh_failure_burst(c.events), "auth ids"),
    _d("router_admin_external_login", lambda c: logons.router_admin_external_login(c.events, c.profile), "auth ids"),
    _d("router_admin_failure_burst", lambda c: logons.router_admin_failure_burst(c.events), "auth ids"),
    _d("unexpected_egress", lambda c: segments.unexpected_egress(c.events, c.profile), "dns firewall flow"),
    _d("inbound_accepted", lambda c: segments.inbound_accepted(c.events, c.profile, c.baseline), "dns firewall flow"),
    _d("time_of_day_anomaly", lambda c: segments.time_of_day_anomaly(c.events, c.profile, c.baseline.metrics, c.baseline.as_of), "dns firewall flow", needs_baseline=True),
    _d("volume_outlier", lambda c: volume.volume_outlier(c.events, c.profile), "firewall"),
    _d("large_transfer", lambda c: volume.large_transfer(c.events, c.profile, c.baseline), "firewall"),
    _d("watchlist_hit", lambda c: correlate.watchlist_hit(c.events, c.baseline), "dns firewall flow", needs_baseline=True),
    _d("internal_scan", lambda c: correlate.internal_scan(c.events, c.profile), "dns firewall flow"),
    _d("ioc_ip_match", lambda c: indicators.ip_match(c.events, c.indicators, c.profile), "firewall flow dns", needs_indicators=True),
    _d("ioc_domain_match", lambda c: indicators.domain_match(c.events, c.indicators), "firewall flow dns", needs_indicators=True),
    _d("root_usage", lambda c: cloud.root_usage(c.events), "auth other ids", **_CLOUD),
    _d("console_login_no_mfa", lambda c: cloud.console_login_no_mfa(c.events), "auth other ids", **_CLOUD),
    _d("console_login_failures", lambda c: cloud.console_login_failures(c.events), "auth other ids", **_CLOUD),
    _d("logging_tampering", lambda c: cloud.logging_tampering(c.events), "auth other ids", **_CLOUD),
    _d("iam_persistence", lambda c: cloud.iam_persistence(c.events), "auth other ids", **_CLOUD),
    _d("storage_change", lambda c: cloud.storage_change(c.events), "auth other ids", **_CLOUD),
    _d("compute_launch", lambda c: cloud.compute_launch(c.events), "auth other ids", **_CLOUD),
    _d("dns_edge_change", lambda c: cloud.dns_edge_change(c.events), "auth other ids", **_CLOUD),
    _d("cross_account", lambda c: cloud.cross_account(c.events), "auth other ids", **_CLOUD),
    _d("permission_probing", lambda c: cloud.permission_probing(c.events), "auth other ids", **_CLOUD),
    _d("secrets_sweep", lambda c: cloud.secrets_sweep(c.events), "auth other ids", **_CLOUD),
    _d("iam_enumeration", lambda c: cloud.iam_enumeration(c.events), "auth other ids", **_CLOUD),
    _d("bucket_sweep", lambda c: cloud.bucket_sweep(c.events), "auth other ids", **_CLOUD),
    _d("unexpected_region", lambda c: cloud.unexpected_region(c.events, c.profile), "auth other ids", **_CLOUD),
    _d("dormant_principal", lambda c: cloud.dormant_principal(c.events, c.profile), "auth other ids", **_CLOUD),
    _d("unexpected_access_key", lambda c: cloud.unexpected_access_key(c.events, c.profile), "auth other ids", **_CLOUD),
    _d("out_of_scope_service", lambda c: cloud.out_of_scope_service(c.events, c.profile), "auth other ids", **_CLOUD),
    _d("out_of_scope_bucket", lambda c: cloud.out_of_scope_bucket(c.events, c.profile), "auth other ids", **_CLOUD),
    _d("blocked_account", lambda c: cloud.blocked_account(c.events, c.profile), "auth other ids", **_CLOUD),
    _d("watched_resource", lambda c: cloud.watched_resource(c.events, c.profile), "auth other ids", **_CLOUD),
    _d("cloud_finding", lambda c: cloud.cloud_finding(c.events), "auth other ids", **_CLOUD),
    _d("magnitude_shift", lambda c: trends.magnitude_shift(c.events, c.baseline), "", needs_baseline=True),
)


def selected(
    context: Context, kinds: Iterable[str], sources: Iterable[str], names: Iterable[str] | None = None
) -> list[Detector]:
    """Detectors whose event kinds, sources and history are there."""
    wanted = set(names) if names is not None else None
    return [
        d
        for d in DETECTORS
        if d.applicable(kinds, sources)
        and (wanted is None or d.name in wanted)
        and (context.baseline is not None or not d.needs_baseline)
        and (context.indicators is not None or not d.needs_indicators)
    ]


def applicable_detectors(events: DataFrame) -> DataFrame:
    """Names of the detectors that the kinds and sources of ``events`` call for."""
    spark = events.sparkSession
    table = spark.createDataFrame(
        [(d.name, sorted(d.kinds), sorted(d.sources)) for d in DETECTORS],
        "detector string, kinds array<string>, sources array<string>",
    )
    kinds = q.kinds_present(events).agg(F.collect_set("kind")).scalar()
    sources = q.sources_present(events).agg(F.collect_set("source")).scalar()
    return table.where(
        ((F.size("kinds") == 0) | F.arrays_overlap("kinds", kinds))
        & ((F.size("sources") == 0) | F.arrays_overlap("sources", sources))
    ).select("detector")


def run_signals(context: Context, names: Iterable[str] | None = None) -> DataFrame:
    """Signals of every applicable detector as one frame, planted events left out.

    Looking up the kinds and sources present is the only action; both lists are short.
    """
    events = q.scope(context.events, exclude_sources=[CANARY_SOURCE])
    return _signals(context, events, names)


def run_canary_signals(context: Context, names: Iterable[str] | None = None) -> DataFrame:
    """The same detectors over the planted events alone."""
    events = q.scope(context.events, only_sources=[CANARY_SOURCE])
    return _signals(context, events, names)


def run_guarded(context: Context, names: Iterable[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Signals of the detectors that went through, and ``detector, error`` of those that didn't.

    Each detector is a job of its own, whose signals are written to the shared folder; one that fails, when
    it is planned or while it runs, leaves the others as they are. Its signals are missing whole, never in part.
    """
    events = q.scope(context.events, exclude_sources=[CANARY_SOURCE])
    spark = events.sparkSession
    kinds = [r[0] for r in q.kinds_present(events).collect()]
    sources = [r[0] for r in q.sources_present(events).collect()]
    scoped = Context(events, context.profile, context.baseline, context.indicators)
    frames, failed = [spark.createDataFrame([], SIGNAL_SCHEMA)], []
    for d in selected(scoped, kinds, sources, names):
        try:
            frames.append(materialize(signal_rows(d.run(scoped)), f"signals-{d.name}"))
        except Exception as e:  # whatever a detector may raise: it is reported with the run
            failed.append((d.name, f"{type(e).__name__}: {e}".strip()))
    return all_of(*frames), spark.createDataFrame(failed, "detector string, error string")


def _signals(context: Context, events: DataFrame, names: Iterable[str] | None) -> DataFrame:
    kinds = [r[0] for r in q.kinds_present(events).collect()]
    sources = [r[0] for r in q.sources_present(events).collect()]
    scoped = Context(events, context.profile, context.baseline, context.indicators)
    frames = [signal_rows(d.run(scoped)) for d in selected(scoped, kinds, sources, names)]
    if not frames:
        return events.sparkSession.createDataFrame([], SIGNAL_SCHEMA)
    return all_of(*frames)


def run_metrics(context: Context) -> DataFrame:
    """Every metric of a run, planted events left out."""
    events = q.scope(context.events, exclude_sources=[CANARY_SOURCE])
    profile, baseline = context.profile, context.baseline
    frames = [
        perimeter.volume_metrics(events),
        perimeter.port_metrics(events, profile),
        perimeter.hourly_metrics(events),
        perimeter.pattern_metrics(events, profile),
        perimeter.traceroute_metrics(events, profile),
        resolver.dns_metrics(events, profile),
        resolver.finding_metrics(events, profile, baseline),
        periodic.beacon_metrics(events, profile),
        logons.auth_metrics(events),
        volume.volume_metrics(events, profile),
        segments.zone_metrics(events, profile),
        segments.zone_daypart_metrics(events, profile),
        correlate.shared_host_metrics(events, profile),
        cloud.audit_metrics(events),
        cloud.finding_count(events),
    ]
    if context.indicators is not None:
        frames.append(indicators.indicator_metrics(events, context.indicators))
    if baseline is not None:
        frames += [
            population.novel_client_metrics(events, profile, baseline),
            trends.trend_metrics(events, baseline),
        ]
    return all_of(*frames)
