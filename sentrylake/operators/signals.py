"""Common shape of detector output.

A detector returns one row per signal with typed evidence columns. ``signal_rows`` wraps the
evidence as JSON when signals of several detectors are stored together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.schema import SIGNAL_SCHEMA, conform

COMMON = ("signal_id", "analyzer", "title", "taxonomy", "severity_hint", "confidence", "entities")


def text(*parts: Column | str | int) -> Column:
    """Concatenate literals (str) and columns."""
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def as_signals(
    rows: DataFrame,
    *,
    signal_id: Column | str,
    analyzer: str,
    title: Column | str,
    taxonomy: str,
    severity: Column | int,
    confidence: Column | float,
    entities: Column,
    evidence: Sequence[Column | str] = (),
) -> DataFrame:
    """Project detector rows to signals; a plain string is a literal, except in ``evidence``."""

    def lit(value):
        return value if isinstance(value, Column) else F.lit(value)

    return rows.select(
        lit(signal_id).alias("signal_id"),
        F.lit(analyzer).alias("analyzer"),
        lit(title).alias("title"),
        F.lit(taxonomy).alias("taxonomy"),
        lit(severity).cast("int").alias("severity_hint"),
        lit(confidence).cast("double").alias("confidence"),
        entities.alias("entities"),
        *evidence,
    )


def signal_rows(signals: DataFrame) -> DataFrame:
    """Signals with their evidence columns folded into one JSON text."""
    extra = [c for c in signals.columns if c not in COMMON]
    evidence = F.to_json(F.struct(*[F.col(f"`{c}`") for c in extra])) if extra else F.lit("{}")
    return conform(
        signals.select(*COMMON, evidence.alias("evidence"), F.lit(False).alias("is_canary")),
        SIGNAL_SCHEMA,
    )


def entities_of(*lists: Column) -> Column:
    """Concatenate entity arrays."""
    return F.concat(*lists)


def distinct_lists(
    rows: DataFrame, keys: Sequence[str], lists: Mapping[str, tuple[Column, int]]
) -> DataFrame:
    """For each group, the first ``k`` distinct values of several expressions, in order.

    Values become (group, list, value) rows and are made distinct with a map-side combine. The rank
    filter is pushed below the shuffle as a per-task limit, so that no task or array ever holds more
    than ``k`` values of one group and list, however many rows a hot group has. An array expression
    contributes its elements.
    """
    schema = rows.select(*[c.alias(name) for name, (c, _) in lists.items()]).schema

    def tag(name: str, column: Column) -> Column:
        is_array = schema[name].dataType.typeName() == "array"
        values = (column if is_array else F.array(column)).cast("array<string>")
        return F.transform(
            F.coalesce(values, F.array().cast("array<string>")),
            lambda v: F.struct(F.lit(name).alias("list"), v.alias("value")),
        )

    tagged = [tag(name, column) for name, (column, _) in lists.items()]
    pairs = (
        rows.select(*keys, F.explode(F.concat(*tagged)).alias("_item"))
        .select(*keys, "_item.list", "_item.value")
        .where(F.coalesce(F.col("value"), F.lit("")) != "")
        .distinct()
    )
    widest = max(k for _, k in lists.values())
    order = Window.partitionBy(*keys, "list").orderBy("value")
    ranked = pairs.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= widest)
    return ranked.groupBy(*keys).agg(
        *[
            F.sort_array(
                F.collect_list(
                    F.when((F.col("list") == name) & (F.col("_rank") <= k), F.col("value"))
                )
            ).alias(name)
            for name, (_, k) in lists.items()
        ]
    )


def join_lists(groups: DataFrame, lists: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach ``distinct_lists`` output; groups without any value get empty arrays."""
    names = [c for c in lists.columns if c not in keys]
    renamed = lists.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *names)
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    on = same[0]
    for test in same[1:]:
        on = on & test
    joined = groups.join(renamed, on, "left").drop(*[f"_k_{k}" for k in keys])
    empty = F.array().cast("array<string>")
    return joined.withColumns({n: F.coalesce(F.col(n), empty) for n in names})


def ordered_list(ranked: DataFrame, measure: str, columns: Sequence[str]) -> Column:
    """Fold a short ranked frame into one array of structs, highest measure first.

    Like ``top_list``, for several columns; the first column decides ties.
    """
    order = (-F.col(measure)).alias("_order")
    return ranked.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(order, *columns))),
            lambda s: s.dropFields("_order"),
        )
    ).scalar()


def top_list(ranked: DataFrame, value: str = "value", measure: str = "n") -> Column:
    """Fold a short ranked frame (already limited) into one ordered array of (value, n) structs.

    The frame has at most the report's row limit, so the array is small. Used as a scalar subquery.
    """
    folded = ranked.agg(
        F.transform(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        (-F.col(measure)).alias("_m"),
                        F.col(value).cast("string").alias("value"),
                        F.col(measure).alias("n"),
                    )
                )
            ),
            lambda s: F.struct(s["value"].alias("value"), s["n"].alias("n")),
        ).alias("items")
    )
    return folded.scalar()
