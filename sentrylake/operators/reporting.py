"""Selection and shaping of run products for a reader, and reputation and sample look-ups."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.functions.scalars import delta_pct, severity_label
from sentrylake.operators import query as q
from sentrylake.operators.history import cache_latest
from sentrylake.profile import Profile
from sentrylake.schema import CANARY_SOURCE, LOW
from sentrylake.session import materialize


def rank_signals(signals: DataFrame, n: int | None = 60) -> DataFrame:
    """The strongest signals, or all of them in that order; planted ones left out."""
    real = signals.where(~F.coalesce("is_canary", F.lit(False))) if "is_canary" in signals.columns else signals
    ranked = real.orderBy(F.desc("severity_hint"), F.desc("confidence"), "signal_id")
    return ranked if n is None else ranked.limit(n)


def top_metrics_per_section(
    metrics: DataFrame, prior: DataFrame | None = None, n: int | None = 25
) -> DataFrame:
    """The first metrics of every section, or all of them, in emit order, with prior value and change."""
    order = Window.partitionBy("section").orderBy("ord", F.desc("value_num"), "key")
    first = metrics.withColumn("rank", F.row_number().over(order))
    if n is not None:
        first = first.where(F.col("rank") <= n)
    if prior is not None:
        first = first.join(prior, "key", "left")
        first = first.withColumn("delta_pct", delta_pct("value_num", "prior"))
    return first


def signal_rollup(signals: DataFrame, *, table_min: int = 5) -> DataFrame:
    """Per taxonomy: signals, weak signals, whether those go into a table, and the note that at
    least two signals share (column ``note``), which then need not be repeated."""
    notes = (
        signals.where(F.coalesce("note", F.lit("")) != "")
        .groupBy("taxonomy", "note")
        .agg(F.count("*").alias("n"))
    )
    shared = notes.groupBy("taxonomy").agg(
        F.max("n").alias("note_count"),
        F.max_by("note", F.struct("n", "note")).alias("shared_note"),
    )
    return (
        signals.groupBy("taxonomy")
        .agg(
            F.count("*").alias("signals"),
            F.count_if(F.col("severity_hint") <= LOW).alias("weak_signals"),
        )
        .join(shared, "taxonomy", "left")
        .withColumn("as_table", F.col("weak_signals") >= table_min)
        .withColumn("shared_note", F.when(F.col("note_count") >= 2, F.col("shared_note")))
        .drop("note_count")
    )


def report_sections(metrics: DataFrame, *, per_section: int = 24) -> DataFrame:
    """Metrics by report section, protocol shares left out."""
    shown = metrics.where(~F.col("key").startswith("fw.proto."))
    return top_metrics_per_section(shown, n=per_section)


def segment_client_counts(metrics: DataFrame) -> DataFrame:
    """Distinct DNS clients and firewall hosts per zone, read back from its metrics."""
    zone = F.regexp_extract("key", r"^zone\.(.*)\.(dns_clients|fw_clients)$", 1)
    return (
        metrics.where(
            (F.col("section") == "segments") & F.col("key").rlike(r"^zone\..*\.(dns_clients|fw_clients)$")
        )
        .groupBy(zone.alias("zone"))
        .agg(
            F.max(F.when(F.col("key").endswith(".dns_clients"), F.col("value_num"))).alias("dns"),
            F.max(F.when(F.col("key").endswith(".fw_clients"), F.col("value_num"))).alias("fw"),
        )
    )


def findings_sorted(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.desc("severity"), "title", "finding_id")


def report_rows(run_id: str, **parts: DataFrame) -> DataFrame:
    """A report of any size as rows ``run_id, part, ord, body``: one JSON text per item.

    Findings come by severity, metrics by section and emit order, everything else by its text. Each
    item stays a row, so nothing is folded into one value; a reader takes the parts it wants.
    """
    hidden = {"is_canary", "evidence"}
    out = None
    for name, df in parts.items():
        columns = [c for c in df.columns if c not in hidden]
        body = F.to_json(F.struct(*columns))
        if name == "findings":
            order = F.format_string("%d %s", F.lit(9) - F.col("severity"), "title")
        elif name == "metrics":
            order = F.format_string("%s %09d", "section", "ord")
        else:
            order = body
        rows = df.select(
            F.lit(run_id).alias("run_id"), F.lit(name).alias("part"), order.alias("ord"), body.alias("body")
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def build_report(
    run_id: str,
    *,
    status: DataFrame,
    findings: DataFrame,
    metrics: DataFrame,
    health: DataFrame,
    canaries: DataFrame,
    actions: DataFrame | None = None,
) -> DataFrame:
    """One row with the whole report of a run as nested columns, for one document per run.

    Pass what a reader gets: reviewed findings, the metrics of ``top_metrics_per_section``, sources.
    ``report_rows`` holds lists of any length.
    """
    item = F.struct(
        (-F.col("severity")).alias("_order"), "title", "finding_id",
        severity_label("severity").alias("severity"), "confidence", "taxonomy", "zone", "entities",
    )
    kept = findings.where(~F.coalesce("suppressed", F.lit(False)))
    hidden = findings.where(F.coalesce("suppressed", F.lit(False)))

    def folded(df: DataFrame, struct):
        return df.agg(F.array_sort(F.collect_list(struct)).alias("items")).scalar()

    columns = {
        "findings": folded(kept, item),
        "finding_count": kept.agg(F.count("*")).scalar(),
        "suppressed": folded(hidden, F.struct("finding_id", "title", F.col("suppressed_reason").alias("reason"))),
        "metrics": folded(
            metrics,
            F.struct("section", "ord", "key", "value_num", "value_text", "unit", "prior", "delta_pct"),
        ),
        "sources": folded(health, F.struct("source", "state", "records", "span_hours", "requested_hours", "notes")),
        "canaries": folded(canaries, F.struct("canary", "detected")),
    }
    if actions is not None:
        columns["actions"] = folded(actions, F.struct("priority", "text", "command"))
    return status.select(F.lit(run_id).alias("run_id"), "status").withColumns(columns)


def signal_samples(
    signals: DataFrame, events: DataFrame, support: DataFrame | None = None, n: int = 10
) -> DataFrame:
    """Events behind each signal: by its record keys, else by its first entity that has events.

    ``support`` has ``signal_id, dedup_key``. Candidates of a signal are ranked before the shuffle
    with a per-task limit, so a hot entity costs each task ``n`` rows.
    """
    events = q.scope(events, exclude_sources=[CANARY_SOURCE])
    probe = lambda order, field, value: F.struct(
        order.cast("int").alias("choice"), F.lit(field).alias("field"), value.alias("value")
    )
    pos = F.col("pos")
    named = signals.select("signal_id", F.posexplode("entities").alias("pos", "e"))
    by_ip = named.where(F.col("e.type") == "ip").select(
        "signal_id",
        F.explode(
            F.array(
                probe(pos * 2 + 1, "src_ip", F.col("e.value")),
                probe(pos * 2 + 2, "client_ip", F.col("e.value")),
            )
        ).alias("p"),
    )
    by_name = named.where(F.col("e.type") == "domain").select(
        "signal_id", probe(pos * 2 + 1, "domain", F.col("e.value")).alias("p")
    )
    probes = by_ip.unionAll(by_name)
    if support is not None:
        keys = support.join(signals.select("signal_id"), "signal_id", "left_semi")
        probes = probes.unionAll(
            keys.select("signal_id", probe(F.lit(0), "dedup_key", F.col("dedup_key")).alias("p"))
        )
    probes = materialize(probes.select("signal_id", "p.*").distinct(), "probes")
    field = lambda name: F.struct(F.lit(name).alias("field"), F.col(name).alias("value"))
    keyed = events.select(
        "id", "ts", "dedup_key",
        F.explode(F.array(*[field(f) for f in ("src_ip", "client_ip", "domain", "dedup_key")])).alias("k"),
    ).select("id", "ts", F.col("dedup_key").alias("event_key"), "k.*").where(F.col("value").isNotNull())
    hits = keyed.join(probes, ["field", "value"])
    order = Window.partitionBy("signal_id", "choice").orderBy(F.desc("ts"), "id", "event_key")
    ranked = hits.withColumn("rank", F.row_number().over(order))
    if n is not None:
        ranked = ranked.where(F.col("rank") <= n)
    best = ranked.groupBy("signal_id").agg(F.min("choice").alias("choice"))
    return ranked.join(best, ["signal_id", "choice"]).select(
        "signal_id", "rank", "id", "ts", F.col("event_key").alias("dedup_key"), "field"
    )


def reputation_join(
    subjects: DataFrame,
    cache: DataFrame,
    profile: Profile,
    as_of: datetime | str,
    *,
    budget: int,
) -> DataFrame:
    """Cached verdicts for subjects, and what still has to be looked up.

    ``subjects`` has ``enricher, subject_type (ip|domain), subject, ord``. Addresses that are not
    routable and harmless names are ``prefiltered``; a fresh answer is ``cached``; of the rest the
    first ``budget`` per enricher are ``pending`` and the others ``refused``.
    """
    from sentrylake.functions.net import is_routable

    name = F.rtrim(F.lower(F.trim("subject")), F.lit("."))
    subject = F.when(F.col("subject_type") == "domain", name).otherwise(F.col("subject"))
    distinct = (
        subjects.select("enricher", "subject_type", subject.alias("subject"), "ord")
        .groupBy("enricher", "subject_type", "subject")
        .agg(F.min("ord").alias("ord"))
    )
    useful = F.when(F.col("subject_type") == "ip", is_routable("subject")).otherwise(
        F.col("subject").contains(".") & ~profile.is_benign_domain("subject")
    )
    distinct = distinct.withColumn("useful", F.coalesce(useful, F.lit(False)))
    answers = cache_latest(cache, as_of).select("enricher", "subject", "verdict")
    known = distinct.join(answers, ["enricher", "subject"], "left")
    waiting = known.where(F.col("useful") & F.col("verdict").isNull()).select("enricher", "subject", "ord")
    order = Window.partitionBy("enricher").orderBy("ord", "subject")
    allowed = (
        waiting.withColumn("_r", F.row_number().over(order))
        .where(F.col("_r") <= budget)
        .select("enricher", "subject", F.lit(True).alias("allowed"))
    )
    state = (
        F.when(~F.col("useful"), "prefiltered")
        .when(F.col("verdict").isNotNull(), "cached")
        .when(F.col("allowed"), "pending")
        .otherwise("refused")
    )
    return known.join(allowed, ["enricher", "subject"], "left").select(
        "enricher", "subject_type", "subject", state.alias("state"),
        F.when(F.col("useful"), F.col("verdict")).alias("verdict"),
    )
