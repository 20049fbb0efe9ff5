"""Connected components of links, by large and small stars; nothing of it passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake.session import materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Edges ``u > v`` from every node's neighbours to the smallest of them and the node itself.

    ``large``: the neighbours above a node, else those below it and the node. The smallest neighbour is an
    aggregate, so a node with very many neighbours is added up before the shuffle.
    """
    both = edges.select("u", "v")
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
    joined = both.join(low, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v")))
    return out.where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node of the links ``a, b``: the root is the smallest node that they reach.

    Each round is written to the shared folder; the number of rounds grows with the logarithm of the
    largest component.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, mark = materialize(edges, "links"), None
    while True:
        edges = materialize(_stars(_stars(edges, True), False), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
