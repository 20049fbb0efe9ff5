"""Rules that submitted findings must pass, suppressions, the overall status and delivery.

``submitted`` findings have ``idx, title, severity, confidence, taxonomy, zone, signal_ids,
event_ids, evidence_kinds, entities, what, why, not_this, action``; ``idx`` numbers them from 1.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.functions.scalars import lookup, parse_severity, severity_label
from sentrylake.operators import query as q
from sentrylake.operators.signals import text
from sentrylake.profile import Profile
from sentrylake.schema import CRITICAL, HIGH, INFO, MEDIUM, SEVERITIES, SUSPECTED
from sentrylake.session import materialize

# Evidence that is behaviour seen on this network.
LOCAL_EVIDENCE = ("local_behavior", "baseline_delta", "correlation", "policy_violation")
# Entity types, confidences and country words.
ENTITY_TYPES = ("ip", "domain", "host", "port", "device", "user")
CONFIDENCES = ("low", "medium", "high")
COUNTRIES = (
    "russia|russian|china|chinese|iran|iranian|north korea|nigeria|romania|"
    "ukraine|vietnam|brazil|india"
)


def _texts(column: str) -> Column:
    return F.coalesce(F.col(column).cast("array<string>"), F.array().cast("array<string>"))


def valid_signals(submitted: DataFrame, signals: DataFrame) -> DataFrame:
    """Per finding: cited signals that exist, in cited order, with their strongest hint."""
    cited = submitted.select("idx", F.posexplode(_texts("signal_ids")).alias("pos", "signal_id"))
    known = signals.select("signal_id", "taxonomy", "severity_hint", "entities")
    hits = cited.join(known, "signal_id")
    return (
        hits.groupBy("idx")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("pos", "signal_id", "taxonomy", "entities"))
            ).alias("cited"),
            F.max("severity_hint").alias("hint"),
        )
        .select(
            "idx",
            F.transform("cited", lambda c: c["signal_id"]).alias("valid_ids"),
            "hint",
            F.col("cited")[0]["taxonomy"].alias("signal_taxonomy"),
            F.flatten(F.transform("cited", lambda c: c["entities"])).alias("signal_entities"),
        )
    )


def cited_event_ids(ids: Column) -> Column:
    """The distinct integers of a cited id list, in cited order."""
    numbers = F.transform(ids.cast("array<string>"), lambda v: v.try_cast("bigint"))
    return F.array_distinct(F.array_compact(numbers))


def valid_events(submitted: DataFrame, events: DataFrame) -> DataFrame:
    """Per finding: cited event ids that are events of this run, ascending."""
    cited = submitted.select("idx", F.explode(cited_event_ids(F.col("event_ids"))).alias("id"))
    cited = materialize(cited, "cited-events")
    real = q.existing_event_ids(events, cited)
    return (
        cited.join(real, "id", "left_semi")
        .groupBy("idx")
        .agg(F.array_sort(F.collect_list("id")).alias("valid_events"))
    )


def judge(submitted: DataFrame, signals: DataFrame, events: DataFrame, profile: Profile) -> DataFrame:
    """Every submitted finding with its verdict: ``rejected`` is null for an accepted finding."""
    none = F.array().cast("array<string>")
    rows = (
        submitted.join(valid_signals(submitted, signals), "idx", "left")
        .join(valid_events(submitted, events), "idx", "left")
        .withColumns(
            {
                "title": F.trim(F.coalesce("title", F.lit(""))),
                "valid_ids": F.coalesce("valid_ids", none),
                "valid_events": F.coalesce("valid_events", F.array().cast("array<bigint>")),
            }
        )
        .withColumn(
            "kinds",
            F.when(F.size(_texts("evidence_kinds")) > 0, _texts("evidence_kinds")).otherwise(
                F.array(F.lit("local_behavior"))
            ),
        )
    )
    local = F.array(*[F.lit(k) for k in LOCAL_EVIDENCE])
    firm = F.array(*[F.lit(k) for k in LOCAL_EVIDENCE if k != "baseline_delta"])
    has_signal = F.size("valid_ids") > 0
    rejected = (
        F.when(F.col("title") == "", "no title")
        .when(~has_signal & (F.size("valid_events") == 0), "cites no known signal or event")
        .when(~F.arrays_overlap("kinds", local), "no local evidence")
    )
    requested = F.coalesce(
        lookup(F.upper(F.trim(F.coalesce("severity", F.lit("INFO")))), SEVERITIES), F.lit(INFO)
    )
    rows = rows.withColumns({"rejected": rejected, "requested": requested})
    over = F.col("requested") > F.col("hint") + 1
    clamped = F.when(over, F.least(F.lit(CRITICAL), F.col("hint") + 1)).otherwise(F.col("requested"))
    rows = rows.withColumn("clamped", clamped)
    hearsay = (
        (F.col("clamped") == CRITICAL)
        & F.array_contains("kinds", "reputation")
        & ~F.arrays_overlap("kinds", firm)
    )
    asked_unrated = F.col("requested") == SUSPECTED
    severity = (
        F.when(~has_signal, SUSPECTED)
        .when(asked_unrated, F.col("hint"))
        .when(hearsay, HIGH)
        .otherwise(F.col("clamped"))
    ).cast("int")
    rows = rows.withColumns({"rated": severity, "hearsay": hearsay, "over": over})
    given = F.filter(
        F.coalesce(F.col("entities"), F.array().cast(_entity_type(submitted))),
        lambda e: F.coalesce(e["type"], F.lit("host")).isin(*ENTITY_TYPES),
    )
    given = F.transform(
        given,
        lambda e: F.struct(
            F.coalesce(e["type"], F.lit("host")).alias("type"),
            F.coalesce(e["value"], F.lit("")).alias("value"),
            F.coalesce(e["role"], F.lit("")).alias("role"),
        ),
    )
    fallback = F.coalesce(F.col("signal_entities"), F.array().cast(_entity_type(submitted)))
    rows = rows.withColumn("named", F.when(F.size(given) > 0, given).otherwise(fallback))
    caveats = F.filter(
        F.transform("named", lambda e: profile.attribution_caveat(e["value"])), lambda c: c != ""
    )
    unknown = F.filter(_texts("signal_ids"), lambda s: ~F.array_contains("valid_ids", s))
    dropped = F.array_except(cited_event_ids(F.col("event_ids")), F.col("valid_events"))
    rows = rows.withColumns(
        {"unknown": unknown, "dropped": F.coalesce(dropped, F.array().cast("array<bigint>"))}
    )
    geography = F.coalesce(F.col("why"), F.lit("")).rlike(rf"(?i)\b({COUNTRIES})\b")
    adjustments = F.array_compact(
        F.array(
            F.when(
                ~has_signal & ~asked_unrated,
                text("recorded as SUSPECTED rather than ", severity_label("requested"),
                     ": only raw events support it"),
            ),
            F.when(
                has_signal & asked_unrated,
                text("rated ", severity_label("hint"), ", its strongest signal's hint, rather than SUSPECTED"),
            ),
            F.when(
                has_signal & ~asked_unrated & F.col("over"),
                text("severity clamped ", severity_label("requested"), " -> ", severity_label("clamped")),
            ),
            F.when(
                has_signal & ~asked_unrated & F.col("hearsay"),
                F.lit("severity lowered CRITICAL -> HIGH: reputation is not evidence of compromise"),
            ),
            F.when(
                geography & (F.col("rated") >= MEDIUM),
                F.lit("geography is context only and was not treated as a severity input"),
            ),
            F.when(
                F.size("unknown") > 0,
                text("dropped unknown signal id(s): ", F.array_join("unknown", ", ")),
            ),
            F.when(
                F.size("dropped") > 0,
                text("dropped event id(s) not in this run: ",
                     F.array_join(F.col("dropped").cast("array<string>"), ", ")),
            ),
        )
    )
    stated = F.lower(F.coalesce("confidence", F.lit("medium")))
    return rows.select(
        "idx",
        text("F", F.col("idx")).alias("finding_id"),
        "title",
        "rejected",
        F.col("rated").alias("severity"),
        F.when(stated.isin(*CONFIDENCES), stated).otherwise("medium").alias("confidence"),
        F.coalesce(
            F.nullif(F.col("taxonomy"), F.lit("")), "signal_taxonomy", F.lit("agent.suspected")
        ).alias("taxonomy"),
        F.coalesce(F.nullif(F.col("zone"), F.lit("")), F.lit("perimeter")).alias("zone"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("what", "why", "not_this", "action")],
        F.col("valid_ids").alias("signal_ids"),
        F.col("valid_events").alias("event_ids"),
        F.col("kinds").alias("evidence_kinds"),
        F.col("named").alias("entities"),
        adjustments.alias("adjustments"),
        F.coalesce(F.get(caveats, F.lit(0)), F.lit("")).alias("attribution_caveat"),
    )


def _entity_type(submitted: DataFrame):
    return submitted.schema["entities"].dataType


def adjudicate_findings(
    submitted: DataFrame, signals: DataFrame, events: DataFrame, profile: Profile
) -> DataFrame:
    """Findings that pass every rule, with evidence checked and severity bounded."""
    return judge(submitted, signals, events, profile).where(F.col("rejected").isNull()).drop("rejected")


def rejected_findings(
    submitted: DataFrame, signals: DataFrame, events: DataFrame, profile: Profile
) -> DataFrame:
    """Findings that fail a rule, and which."""
    return (
        judge(submitted, signals, events, profile)
        .where(F.col("rejected").isNotNull())
        .select("idx", "title", "rejected")
    )


# ----- suppressions


def suppression_hits(findings: DataFrame, suppressions: DataFrame) -> DataFrame:
    """``finding_id, rule`` (id and reason) of suppressions that fit, only the first of rules alike in all parts.

    A rule is found by equality of its parts with what a finding offers: its taxonomy or none, each of its
    entities or none, each distinct rule text in its title or none. So a finding meets at most the ceilings
    of these keys, however many rules name its taxonomy.
    """
    key, parts = "finding_id", ("taxonomy", "entity", "title_contains")
    rules = suppressions.select(
        "id", "reason", *[F.nullif(F.col(c), F.lit("")).alias(c) for c in parts[:2]],
        F.lower(F.nullif("title_contains", F.lit(""))).alias("title_contains"),
        parse_severity("max_severity").alias("ceiling"),
    ).where(F.col("id").isNotNull() & F.coalesce(*parts).isNotNull())
    rules = materialize(rules.groupBy(*parts, "ceiling").agg(F.min(F.struct("id", "reason")).alias("rule")), "suppression-rules")
    none = F.array(F.lit(None).cast("string"))
    offered = lambda values: F.array_distinct(F.concat(none, F.coalesce(values, F.array().cast("array<string>"))))
    keys = (
        findings.select(
            key, "severity", F.array_distinct(F.array(F.lit(None), F.col("taxonomy"))).alias("taxonomies"),
            offered(F.transform("entities", lambda e: e["value"])).alias("values"),
            F.lower("title").alias("title"),
        )
        .withColumn("texts", rules.agg(F.collect_set("title_contains")).scalar())
        .withColumn("texts", offered(F.filter("texts", lambda x: F.contains(F.col("title"), x))))
        .select(key, "severity", F.explode("taxonomies").alias("taxonomy"), "values", "texts")
        .select(key, "severity", "taxonomy", F.explode("values").alias("entity"), "texts")
        .select(key, "severity", "taxonomy", "entity", F.explode("texts").alias("title_contains"))
        .where(F.coalesce(*parts).isNotNull())
    )
    keys, rules = keys.alias("k"), rules.alias("r")
    met = reduce(lambda a, b: a & b, (F.col(f"k.{c}").eqNullSafe(F.col(f"r.{c}")) for c in parts))
    below = F.col("r.ceiling").isNull() | (F.col("k.severity") <= F.col("r.ceiling"))
    return keys.join(rules, met & below).select(F.col(f"k.{key}").alias(key), "r.rule")


def apply_suppressions(findings: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Findings with the first active suppression that fits, if any.

    ``suppressions`` has ``id, taxonomy, entity, title_contains, max_severity, reason``; unset parts
    do not restrict, and a suppression with none of the first three never fits.
    """
    key = "finding_id"
    first = (
        suppression_hits(findings, suppressions).groupBy(key).agg(F.min("rule").alias("rule"))
        .select(key, F.col("rule.id").alias("suppression_id"), F.col("rule.reason").alias("_reason"))
    )
    return (
        findings.drop("suppressed", "suppressed_reason")
        .join(first, key, "left")
        .withColumn("suppressed", F.col("suppression_id").isNotNull())
        .withColumn(
            "suppressed_reason",
            F.when(
                F.col("suppressed"),
                F.coalesce(F.nullif(F.col("_reason"), F.lit("")), F.lit("suppressed")),
            ),
        )
        .drop("_reason")
    )


# ----- status and delivery


def rollup_status(findings: DataFrame, canaries: DataFrame | None = None) -> DataFrame:
    """One row: counts by severity and the overall status; unrated findings do not count."""
    row = findings.agg(
        *[
            F.count_if(F.col("severity") == rank).alias(name)
            for name, rank in (("criticals", CRITICAL), ("highs", HIGH), ("mediums", MEDIUM))
        ]
    )
    ok = F.lit(True)
    if canaries is not None:
        ok = F.coalesce(canaries.agg(F.bool_and("detected")).scalar(), F.lit(True))
    row = row.withColumn("canaries_ok", ok)
    red = (F.col("criticals") > 0) | (F.col("highs") >= 2) | ~F.col("canaries_ok")
    amber = (F.col("highs") > 0) | (F.col("mediums") >= 3)
    return row.withColumn("status", F.when(red, "RED").when(amber, "AMBER").otherwise("GREEN"))


def delivery_gate(
    status: DataFrame,
    health: DataFrame,
    findings: DataFrame,
    *,
    run_when: Sequence[str] = ("GREEN", "AMBER", "RED"),
    important_only: bool = False,
    min_severity: int | None = None,
) -> DataFrame:
    """Whether a report is important, and whether a channel with these settings delivers it."""
    unusable = health.agg(F.count_if(~F.col("usable"))).scalar()
    worst = findings.agg(F.max("severity")).scalar()
    rows = status.withColumns({"unusable_sources": unusable, "worst_severity": worst})
    rows = rows.withColumn(
        "important",
        F.col("status").isin("AMBER", "RED") | ~F.col("canaries_ok") | (F.col("unusable_sources") > 0),
    )
    deliver = F.col("status").isin(*run_when)
    if important_only:
        deliver = deliver & F.col("important")
    if min_severity is not None:
        deliver = deliver & F.coalesce(F.col("worst_severity") >= min_severity, F.lit(False))
    return rows.withColumn("deliver", deliver)


# ----- other submitted lists


def _said(column: str) -> Column:
    return F.trim(F.coalesce(F.col(column), F.lit("")))


def clean_watchlist_updates(raw: DataFrame) -> DataFrame:
    days = F.coalesce(F.col("expires_days").cast("string").try_cast("int"), F.lit(7))
    return raw.where(_said("entity_value") != "").select(
        F.coalesce("entity_type", F.lit("ip")).alias("entity_type"),
        _said("entity_value").alias("entity_value"),
        F.coalesce("reason", F.lit("")).alias("reason"),
        F.greatest(F.lit(1), F.least(F.lit(365), days)).alias("expires_days"),
    )


def clean_watchlist_removals(raw: DataFrame) -> DataFrame:
    return raw.where(_said("entity_value") != "").select(
        F.coalesce("entity_type", F.lit("ip")).alias("entity_type"),
        _said("entity_value").alias("entity_value"),
        F.coalesce("reason", F.lit("")).alias("reason"),
    )


def clean_trends(raw: DataFrame) -> DataFrame:
    kind = F.upper(F.coalesce("kind", F.lit("")))
    return raw.where(
        kind.isin("NEW", "RECURRING", "ESCALATING", "RESOLVED") & (_said("text") != "")
    ).select(kind.alias("kind"), _said("text").alias("text"))


def clean_actions(raw: DataFrame) -> DataFrame:
    priority = F.coalesce(F.col("priority").cast("string").try_cast("int"), F.lit(5))
    return raw.where(_said("text") != "").select(
        priority.alias("priority"), _said("text").alias("text"),
        F.coalesce("command", F.lit("")).alias("command"),
    )


def clean_gaps(raw: DataFrame) -> DataFrame:
    return raw.where(_said("what") != "").select(
        _said("what").alias("what"), _said("suggestion").alias("suggestion"),
        cited_event_ids(F.col("event_ids")).alias("event_ids"),
    )
