"""The place of every row in its group, for groups of any size: no window over a group, no group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.llm.common import partitions
from sentrylake.session import materialize

#: ``monotonically_increasing_id`` counts the rows of a partition in its lower bits.
_BITS = 33


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Equality of columns in which nulls equal each other."""
    return reduce(Column.__and__, [left[n].eqNullSafe(right[n]) for n in names])


def pieces(rows: DataFrame, group: list[str], order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Rows sorted by ``group`` and ``order`` over all tasks, and what each task has of each group.

    The first frame is ``rows`` with ``part`` and ``pos``, the place in the task; the second has for each
    ``part`` and group ``first`` (the lowest place), ``before`` (rows of the group in earlier parts) and
    ``total`` (rows of the group). It is as long as there are groups and parts, whatever a group holds. The
    sort keys should tell rows apart, then a group of a third of all rows spans as many tasks as it should.
    """
    keys = [*group, *order]
    spread = rows.repartitionByRange(partitions(rows), *keys).sortWithinPartitions(*keys)
    mid = F.monotonically_increasing_id()
    placed = spread.withColumn("mid", mid).select(*rows.columns, F.shiftright("mid", _BITS).cast("int").alias("part"), F.col("mid").bitwiseAND((1 << _BITS) - 1).alias("pos"))
    placed = materialize(placed, name)
    found = placed.groupBy("part", *group).agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    own = Window.partitionBy(*group)
    earlier = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return placed, materialize(
        found.select("part", *group, "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(own).alias("total")),
        f"{name}-pieces",
    )


def ranked(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``idx``, their place in their group from 0, and ``n``, the rows of the group; null groups are a group."""
    placed, found = pieces(rows, group, order, name)
    joined = placed.join(found, (placed["part"] == found["part"]) & same(placed, found, group))
    return joined.select(*[placed[c] for c in rows.columns], (placed["pos"] - found["first"] + found["before"]).alias("idx"), found["total"].alias("n"))
