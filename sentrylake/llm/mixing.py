"""Mix sources to target weights: exact budgets from counts of documents by length, filled by a bounded knapsack.

A source whose target is several times its words is taken whole as often as that goes; what is left of the
target, its remaining budget, is less than its words. Of every length the same share of documents is taken
towards it but for the last words, and those are fitted exactly: a bounded knapsack over the counts of the
documents left, by length, finds the sum nearest to the budget. Which documents of a length are taken is
drawn by a seeded hash of their ids, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.llm.ranking import pieces, ranked
from sentrylake.session import materialize

#: Words at the end of a budget that the knapsack fits, or twice the longest text of the source if that is more.
FITTED = 1 << 16


def words_in(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """``source, words, target``: all words shared by weight, none above ``most`` times its source's words.

    ``weights`` repeat over the sources in bytewise order, null last. What a stopped source leaves is shared
    again by weight until none is above; a round is an aggregate over the sources, of which the driver sees
    two sums.
    """
    names = [f"when {j} then {w}" for j, w in enumerate(weights)]
    placed = ranked(sources.selectExpr("0 as all", "source is null as unnamed", "source", "words"), ["all"], ["unnamed", "source"], "mix-sources")
    known = materialize(placed.selectExpr("source", "words", f"cast(case idx % {len(weights)} {' '.join(names)} end as long) as weight"), "mix-weights")
    words, every = known.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    left, weight = words, every
    while True:  # the share of a unit of weight only rises, so a stopped source stays so
        above = F.expr(f"cast({most} * words as decimal(38, 0)) * {weight} < cast(weight as decimal(38, 0)) * {left}")
        capped, heavy = known.where(above).agg(F.coalesce(F.sum("words"), F.lit(0)) * most, F.coalesce(F.sum("weight"), F.lit(0))).first()
        if (words - capped, every - heavy) == (left, weight):
            break
        left, weight = words - capped, every - heavy
    share = F.expr(f"cast(cast(weight as decimal(38, 0)) * {left} as double) / {max(1, weight)}")
    return known.select("source", "words", F.when(above, (most * F.col("words")).cast("double")).otherwise(share).alias("target"))


def nearest_sum(sizes: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """How many of each size to take, ``counts`` at most, so that their sum is nearest to ``budget``; of two as near the lower.

    Sums that can be reached grow item by item, where an item is a size 1, 2, 4, .. times; each sum keeps the
    item that reached it first, which is what a solution is read back from. Sizes are above 0.
    """
    taken = np.zeros(len(sizes), np.int64)
    total = int((sizes * counts).sum())
    if budget <= 0 or total <= budget:
        return taken if budget <= 0 else counts.astype(np.int64)
    top = min(total, int(2 * budget) + 1)  # beyond that, nothing at all is nearer
    best = min((int(np.floor(budget)), int(np.ceil(budget))), key=lambda v: (abs(v - budget), v))
    first = np.full(top + 1, -1, np.int32)
    reached = np.zeros(top + 1, bool)
    reached[0] = True
    items: list[tuple[int, int]] = []
    for i in np.random.default_rng(len(sizes)).permutation(len(sizes)):
        size, rest, times = int(sizes[i]), min(int(counts[i]), top // int(sizes[i])), 1
        while rest and not reached[best]:
            times = min(times, rest)
            step = size * times
            new = np.flatnonzero(reached[: top + 1 - step] & ~reached[step:]) + step
            first[new], reached[new] = len(items), True
            items.append((int(i), times))
            rest, times = rest - times, 2 * times
        if reached[best]:
            break
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:
        i, times = items[first[at]]
        taken[i] += times
        at -= int(sizes[i]) * times
    return taken


def _fill(group: pd.DataFrame) -> pd.DataFrame:
    """For the lengths of one source: how many documents of each length its remaining budget takes."""
    group = group.sort_values("size", ascending=False, ignore_index=True)
    fitted = int(group["fitted"].iloc[0])
    sizes, more = group["size"].to_numpy(np.int64), group["share"].to_numpy(np.int64)
    free = group["n"].to_numpy(np.int64) - more
    left = float(group["budget"].iloc[0]) - float((sizes * more).sum())
    for i in range(len(sizes) if left > fitted else 0):  # what rounding down left beyond the fitted words, longest first
        times = min(int(free[i]), int(max(0.0, left - fitted) // sizes[i]))
        more[i], free[i], left = more[i] + times, free[i] - times, left - float(times * sizes[i])
    usable = np.flatnonzero(free > 0)
    more[usable] += nearest_sum(sizes[usable], free[usable], left)
    return group.assign(more=more)[["source", "size", "copies", "more", "words", "target"]]


def plan(lengths: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, fitted: int = FITTED) -> DataFrame:
    """``source, size, copies, more, words, target``: every document of this length ``copies`` times, ``more`` of them once more.

    ``lengths`` counts documents: ``source, size, n``. The lengths of one source are one task's, as many as
    it has different lengths, whatever their documents.
    """
    sources = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.greatest(F.lit(fitted), 2 * F.max("size")).alias("fitted"))
    goals = targets(sources.select("source", "words"), weights, most)
    goals = goals.join(sources.selectExpr("source as of", "fitted"), F.expr("source <=> of")).drop("of")
    goals = goals.selectExpr("fitted", "source as of", "words", "target", f"cast(least({most}, if(words = 0, 0, floor(target / words))) as long) as copies")
    joined = lengths.join(goals.withColumn("budget", F.expr("greatest(0D, target - copies * words)")), F.expr("source <=> of")).drop("of")
    sized = joined.where("size > 0").withColumn("share", F.expr("cast(least(n, floor(n * (greatest(0D, budget - fitted) / words))) as long)"))
    filled = sized.groupBy("source").applyInPandas(_fill, "source string, size long, copies long, more long, words long, target double")
    return filled.unionByName(joined.where("size = 0").selectExpr("source", "size", "0L as copies", "0L as more", "words", "target"))


def mix(records: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 11, fitted: int = FITTED) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` of all ``records`` (``doc_id, source, size``).

    ``taken`` is the size times how often the mix takes the document, 0 to ``most`` times; the sum over a
    source is as near to its target as its lengths allow. Null sources are one source, a null size counts 0
    and is never taken, null ids are drawn like others, repeated rows are documents of their own. Without rows
    there is no result. A source, or a length of it, may hold any share of the rows: lengths are counted before
    they meet, and documents are numbered by a sort over all tasks.
    """
    rows = records.selectExpr("doc_id", "source", "coalesce(cast(size as long), 0) as size", f"xxhash64({seed}L, doc_id) as draw", "monotonically_increasing_id() as salt")
    rows = materialize(rows, "mix-rows")
    lengths = materialize(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-lengths")
    chosen = materialize(plan(lengths, weights, most, fitted), "mix-plan")
    placed, found = pieces(rows, ["source", "size"], ["draw", "salt"], "mix-places")
    found = found.join(chosen.withColumnsRenamed({"source": "of", "size": "at"}), F.expr("source <=> of and size = at")).drop("of", "at")
    found = materialize(found.withColumnsRenamed({"part": "in_part", "source": "of", "size": "at"}), "mix-pieces")
    joined = placed.join(found, F.expr("part = in_part and source <=> of and size = at"))
    return joined.selectExpr(
        "doc_id", "source", "size", "words as source_size", "target", "size * (copies + if(pos - first + before < more, 1, 0)) as taken"
    )
