"""Merkle manifest of a table: a tree of every group, a tree over their roots, and for each row its path to the one root.

A level of all trees is one table of nodes ``(group, idx, n, h)``; its siblings are found by equi-joins with
computed indices, so a level costs the same however the groups are sized. Slot-zero rows, which then know
all nodes of their run, become the next level. Paths go down the same way: a node's path is its own siblings
and the path of its parent, so the rows handled shrink by the arity from level to level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.llm.ranking import ranked
from sentrylake.session import materialize

#: A node's siblings before it and after it in its run, and those of its ancestors in turn; digests as bytes.
PATH = "array<struct<left: binary, right: binary>>"
#: On the way down every so many levels are written: a plan stays short, and a lost executor costs these levels at most.
_WRITTEN = 4


def text_of(digests: Column) -> Column:
    """Digests, one or several in a row, as lower-case hexadecimal text."""
    return F.lower(F.hex(digests))


def _hash(text: Column) -> Column:
    """SHA-256 of a text as bytes."""
    return F.unhex(F.sha2(text, 256))


def field(column: Column) -> Column:
    """A value as it enters a leaf: ``-`` for null, else its bytes in UTF-8, a colon and itself; integers in decimals."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(*columns: Column) -> Column:
    """The leaf of a row of these columns, 32 bytes."""
    return _hash(F.concat(*[field(c) for c in columns]))


def _level(nodes: DataFrame, arity: int, carry: list[str]) -> DataFrame:
    """Nodes with the digests ``left`` and ``right`` of them in their runs; the last run may be short."""
    if arity == 2:
        targets = ["idx ^ 1"]
    else:
        targets = [f"idx - idx % {arity} + (idx % {arity} + {d}) % {arity}" for d in range(1, arity)]
    out = nodes.selectExpr("*", *[f"{t} as t{d}" for d, t in enumerate(targets)])
    for d in range(len(targets)):
        other = nodes.selectExpr("g as og", "idx as oi", f"h as h{d}")
        out = out.join(other, F.expr(f"g <=> og and t{d} = oi"), "left").drop("og", "oi")

    def run(side: str) -> str:
        cases = [" ".join(f"when t{d} % {arity} = {j} then h{d}" for d in range(len(targets))) for j in range(arity)]
        return "concat(" + ", ".join(f"coalesce(case when not {j} {side} idx % {arity} then null {case} end, unhex(''))" for j, case in enumerate(cases)) + ")"

    return out.selectExpr("g", "idx", "n", "h", run("<") + " as left", run(">") + " as right", *carry)


def _parents(level: DataFrame, arity: int) -> DataFrame:
    """The next level: one node for each run that isn't a tree's only node."""
    first = level.where(f"n > 1 and idx % {arity} = 0")
    return first.selectExpr("g", f"idx div {arity} as idx", f"(n + {arity - 1}) div {arity} as n", "unhex(sha2(lower(hex(concat(h, right))), 256)) as h")


def _grow(nodes: DataFrame, arity: int, carry: list[str], name: str) -> list[DataFrame]:
    """All levels from the leaves up, each written with the siblings of its nodes, until every tree has one node."""
    most = nodes.agg(F.max("n")).first()[0]
    levels = []
    while True:
        levels.append(materialize(_level(nodes, arity, carry), f"{name}-up"))
        if most <= 1:
            return levels
        nodes, carry, most = _parents(levels[-1], arity), [], -(-most // arity)


def _tops(levels: list[DataFrame]) -> DataFrame:
    """``g, h`` of every tree's last node."""
    return reduce(DataFrame.unionByName, [level.where("n = 1").select("g", "h") for level in levels])


def _paths(levels: list[DataFrame], above: DataFrame, arity: int, carry: list[str], name: str) -> DataFrame:
    """Nodes of the lowest level with ``path`` and ``top``; ``above`` has path and top of each tree's last node."""
    below = None
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        own = ["g", "idx", "h", *(carry if depth == 0 else [])]
        last = level.where("n = 1")
        found = last.join(above.withColumnRenamed("g", "tree"), F.expr("g <=> tree")).select(*own, "path", "top")
        if below is not None:
            parent = below.selectExpr("g as pg", "idx as pi", "path as rest", "top")
            joined = level.where("n > 1").join(parent, F.expr(f"g <=> pg and idx div {arity} = pi"))
            found = found.unionByName(joined.selectExpr(*own, "concat(array(struct(left, right)), rest) as path", "top"))
        below = materialize(found, f"{name}-down") if depth and depth % _WRITTEN == 0 else found
    return below


def manifest(rows: DataFrame, arity: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """``id, g, leaf, idx, path, top, root`` and the ``carry`` columns of every row of ``rows`` (``id, g, leaf``).

    Rows of a group ``g`` ascend by ``id`` (nulls first; rows of one id by their leaves, alike rows in any
    order, which changes no digest). ``arity`` consecutive nodes become the hash of their digests as text, the
    last run may be short, even of one node; a group of one row is its own ``top``. The tops ascend by group
    (null first, bytewise) and give ``root`` likewise. An empty table has no root and gives no rows.

    ``path`` holds for every level, from the leaf to the root, the siblings before and after. A group that
    holds a third of all rows is dealt to tasks like any other: places come from a sort over all tasks, and
    all joins are on the group and an index.
    """
    if arity < 2:
        raise ValueError("a run has two nodes at least")
    carried = list(carry)
    salted = materialize(rows.select("id", "g", "leaf", *carried, F.monotonically_increasing_id().alias("salt")), "merkle-leaves")
    placed = ranked(salted, ["g"], ["id", "leaf", "salt"], "merkle-places")
    leaves = placed.select("g", "idx", "n", F.col("leaf").alias("h"), "id", *carried)
    if not salted.take(1):
        return leaves.select("id", "g", F.col("h").alias("leaf"), "idx", F.array().cast(PATH).alias("path"), F.col("h").alias("top"), F.col("h").alias("root"), *carried)
    levels = _grow(leaves, arity, ["id", *carried], "merkle")
    tops = materialize(_tops(levels), "merkle-tops")

    one = ranked(tops.select(F.lit(0).alias("all"), F.col("g").alias("name"), "h"), ["all"], ["name"], "merkle-groups")
    upper = _grow(one.select(F.col("all").alias("g"), "idx", "n", "h", "name"), arity, ["name"], "merkle-roots")
    root = upper[-1].where("n = 1").first()["h"]
    start = upper[-1].where("n = 1").select("g", F.array().cast(PATH).alias("path"), F.col("h").alias("top"))
    named = _paths(upper, start, arity, ["name"], "merkle-roots")
    above = materialize(named.select(F.col("name").alias("g"), "path", F.col("h").alias("top")), "merkle-above")

    found = _paths(levels, above, arity, ["id", *carried], "merkle")
    return found.select("id", "g", F.col("h").alias("leaf"), "idx", "path", "top", F.lit(bytes(root)).alias("root"), *carried)


def proof_of(path: Column) -> Column:
    """All siblings of a path as text, level by level, from left to right."""
    return F.aggregate(path, F.lit(""), lambda text, step: F.concat(text, text_of(step["left"]), text_of(step["right"])))


def folded(path: Column, leaf: Column) -> Column:
    """The root, as hexadecimal text, that a leaf has with these siblings."""
    return F.aggregate(path, text_of(leaf), lambda h, step: F.sha2(F.concat(text_of(step["left"]), h, text_of(step["right"])), 256))
