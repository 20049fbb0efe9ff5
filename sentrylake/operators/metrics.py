"""Metric rows: one statistic per row, numeric or text, with its report section and emit order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.schema import METRIC_SCHEMA, conform


@dataclass(frozen=True)
class Stat:
    """One metric read from a one-row frame."""

    key: str
    value: Column | str
    section: str
    label: str
    unit: str | None = None
    text: bool = False


def _struct(ord_: Column, section, key, number, text, unit, label) -> Column:
    return F.struct(
        F.lit(section).alias("section") if isinstance(section, str) else section.alias("section"),
        ord_.cast("int").alias("ord"),
        key.alias("key"),
        number.cast("double").alias("value_num"),
        text.cast("string").alias("value_text"),
        F.lit(unit).cast("string").alias("unit"),
        label.alias("label"),
    )


def stats(row: DataFrame, wanted: Sequence[Stat], start: int = 0) -> DataFrame:
    """Turn a one-row frame into metric rows; a metric whose value is null is left out."""
    items = []
    for i, s in enumerate(wanted):
        value = F.col(s.value) if isinstance(s.value, str) else s.value
        number = F.lit(None) if s.text else value
        words = value if s.text else F.lit(None)
        items.append(
            _struct(F.lit(start + i), s.section, F.lit(s.key), number, words, s.unit, F.lit(s.label))
        )
    rows = row.select(F.explode(F.array(*items)).alias("m")).select("m.*")
    return conform(
        rows.where(F.col("value_num").isNotNull() | F.col("value_text").isNotNull()), METRIC_SCHEMA
    )


def ranking(
    ranked: DataFrame,
    *,
    prefix: str,
    section: str,
    start: int,
    value: str = "value",
    measure: str = "n",
    label: Column | None = None,
) -> DataFrame:
    """One metric per row of a short ranked frame, in rank order."""
    name = F.col(value).cast("string")
    rows = ranked.select(
        _struct(
            F.lit(start),
            section,
            F.concat(F.lit(prefix), name),
            F.col(measure),
            F.lit(None),
            None,
            name if label is None else label,
        ).alias("m")
    ).select("m.*")
    return conform(rows, METRIC_SCHEMA)


def all_of(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
