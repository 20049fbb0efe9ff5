"""Benchmark passages in documents by greedy string tiling, so that reordered passages are caught too."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake.llm.common import frugal, pick, span_hashes, word_spans, words_of
from sentrylake.session import materialize

#: Shortest tile in words, and the share of an item's words that tiles must cover.
MIN_MATCH, COVERAGE = 5, 0.5
#: Bits of the filter that each task gets, whatever the benchmark: a seed that isn't in it is in no item.
FILTER_BITS = 1 << 22
_FACTOR, _PRIME = 1_000_003, (1 << 61) - 1


def _windows(words: list[bytes], k: int) -> np.ndarray:
    """Hash of each run of ``k`` words; none if there are fewer."""
    if k < 1 or len(words) < k:
        return np.zeros(0, np.uint64)
    data, starts, ends = word_spans(words)
    return span_hashes(data, starts[: len(words) - k + 1], ends[k - 1 :])


def _runs(free: np.ndarray, s: int, tokens: list[int]):
    """Hash and place of each run of ``s`` unmarked tokens, by running Karp-Rabin."""
    high, h, size = pow(_FACTOR, s - 1, _PRIME), 0, 0
    for i, token in enumerate(tokens):
        if not free[i]:
            h = size = 0
            continue
        if size == s:
            h -= tokens[i - s] * high
            size -= 1
        h = (h * _FACTOR + token) % _PRIME
        size += 1
        if size == s:
            yield h, i - s + 1


def greedy_tiles(left: list, right: list, min_match: int = MIN_MATCH, breaks: frozenset[int] = frozenset()) -> list[tuple[int, int, int]]:
    """Tiles ``(place in left, place in right, length)``: longest matches first, no token in two of them.

    Of matches of one length that with the lowest places is marked first. No tile runs over a break, a place
    in ``left`` where something was left out.
    """
    numbers: dict = {}
    a, b = ([numbers.setdefault(x, len(numbers) + 1) for x in side] for side in (left, right))
    free_a, free_b, tiles = np.ones(len(a), bool), np.ones(len(b), bool), []
    min_match = max(1, min_match)
    s = max(min_match, min(len(b), 32))
    while True:
        places: dict[int, list[int]] = {}
        for h, j in _runs(free_b, s, b):
            places.setdefault(h, []).append(j)
        longest, found = s, []
        for h, i in _runs(free_a, s, a):
            for j in places.get(h, ()):
                n = 0
                while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n] and not (n and i + n in breaks):
                    n += 1
                if n > longest:
                    longest, found = n, [(i, j)]
                elif n == longest:
                    found.append((i, j))
        for i, j in found:
            if free_a[i : i + longest].all() and free_b[j : j + longest].all():
                free_a[i : i + longest] = free_b[j : j + longest] = False
                tiles.append((i, j, longest))
        if not found:
            if s == min_match:
                return tiles
            s = max(min_match, s // 2)


def _items(benchmark: DataFrame, item_id: str, text: str, min_match: int) -> DataFrame:
    """``item, n_words, words, seeds, times``: how often each seed is in the item; one shorter than a tile is one seed as a whole."""

    def run(batches):
        for batch in batches:
            words = [words_of(x) for x in batch.column(1).to_pylist()]
            found = [np.unique(_windows(w, min(len(w), min_match)), return_counts=True) for w in words]
            seeds, times = [u.view(np.int64) for u, _ in found], [n for _, n in found]
            columns = [batch.column(0), pa.array(map(len, words), pa.int32()), pa.array([b" ".join(w).decode("utf-8", "surrogatepass") for w in words], pa.string()), pa.array(seeds, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["item", "n_words", "words", "seeds", "times"])

    rows = pick(benchmark, item=item_id, text=text)
    kind = rows.schema["item"].dataType.simpleString()
    return rows.mapInArrow(frugal(run), f"item {kind}, n_words int, words string, seeds array<long>, times array<long>")


def _hits(docs: DataFrame, lengths: list[int], bits: np.ndarray) -> DataFrame:
    """Documents with a window that may be a seed: those windows' hashes, and the words in them with their places."""

    def run(batches):
        for batch in batches:
            out = []
            for text_hash, doc_id, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                words = words_of(text.as_py())
                inside, seeds = np.zeros(len(words) + 1, np.int64), []
                for k in lengths:
                    h = _windows(words, k)
                    slot = (h & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
                    hit = np.flatnonzero((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
                    seeds.append(h[hit])
                    np.add.at(inside, hit, 1)
                    np.add.at(inside, hit + k, -1)
                seeds = np.unique(np.concatenate([np.zeros(0, np.uint64), *seeds])).view(np.int64)
                if len(seeds):
                    at = np.flatnonzero(np.cumsum(inside)[:-1])
                    out.append((text_hash.as_py(), doc_id.as_py(), seeds, at, b" ".join(words[i] for i in at).decode("utf-8", "surrogatepass")))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), batch.schema.field(1).type, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["text_hash", "doc_id", "seeds", "places", "words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(frugal(run), f"text_hash long, doc_id {kind}, seeds array<long>, places array<long>, words string")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, filter_bits: int = FILTER_BITS,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``doc_id, text_hash, item_id, n_words, n_covered, coverage, tiles`` of pairs that reach the coverage.

    Words are those between white space, A-Z in lower case. Documents and items are joined on runs of
    ``min_match`` words that both have (seeds); a pair whose common seeds have so few places in the item that
    tiles cannot cover enough is left out. The others are tiled: the longest common run that has no marked word is marked, again
    and again, down to ``min_match`` words. Tiles lie in windows that are seeds, so only those windows of a
    document are compared, and the result is that of its whole text. An item shorter than ``min_match`` must
    occur as a whole; an item or a document without words matches nothing. Every row is a document or an
    item, also repeated ones and those with a null id; ``text_hash`` (xxhash64) tells rows of one id apart.
    """
    if filter_bits & (filter_bits - 1) or filter_bits < 8:
        raise ValueError("the filter's size must be a power of two")
    items = materialize(_items(benchmark, item_id, item_text, min_match), "benchmark-items").where("n_words > 0")
    lengths = sorted(r[0] for r in items.select(F.least("n_words", F.lit(min_match))).distinct().collect())  # at most min_match
    slots = items.select(F.explode("seeds").alias("seed")).select(F.col("seed").bitwiseAND(F.lit(filter_bits - 1)).alias("slot")).distinct()
    bits = np.zeros(filter_bits, np.uint8)
    bits[slots.toArrow()["slot"].to_numpy()] = 1  # at most filter_bits rows
    rows = pick(docs, doc_id=doc_id, text=text).select(F.xxhash64("text").alias("text_hash"), "doc_id", "text")
    # a number for each row, fixed once it is written
    hits = materialize(_hits(rows, lengths, np.packbits(bits, bitorder="little")).withColumn("row", F.monotonically_increasing_id()), "benchmark-hits")

    seeds = items.select(F.col("item").alias("item_id"), "n_words", F.explode(F.arrays_zip("seeds", "times")).alias("x")).select("item_id", "n_words", "x.seeds", "x.times").withColumnRenamed("seeds", "seed")
    pairs = hits.select("row", F.explode("seeds").alias("seed")).join(seeds, "seed").groupBy("row", "item_id", "n_words").agg(F.sum("times").alias("places"))
    pairs = pairs.where(F.col("places") * min_match >= F.col("n_words") * coverage)
    pairs = pairs.drop("places").join(hits.drop("seeds"), "row").join(items.select(F.col("item").alias("item_id"), F.col("words").alias("item_words")), "item_id")

    @F.pandas_udf("array<struct<doc_word: int, item_word: int, length: int>>")
    def tile(words: pd.Series, places: pd.Series, item_words: pd.Series) -> pd.Series:
        out = []
        for left, at, right in zip(words, places, item_words, strict=True):
            breaks = frozenset((np.flatnonzero(np.diff(at) != 1) + 1).tolist())
            right = right.split(" ")
            out.append([{"doc_word": int(at[i]), "item_word": j, "length": n} for i, j, n in greedy_tiles(left.split(" "), right, min(min_match, len(right)), breaks)])
        return pd.Series(out)

    tiled = pairs.withColumn("tiles", tile("words", "places", "item_words"))
    tiled = tiled.withColumn("n_covered", F.aggregate("tiles", F.lit(0), lambda n, t: n + t["length"])).withColumn("coverage", F.col("n_covered") / F.col("n_words"))
    return tiled.where(F.col("coverage") >= coverage).select("doc_id", "text_hash", "item_id", "n_words", "n_covered", "coverage", "tiles")


def without_contaminated(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of which no row of ``found`` has the id and the text, with all their columns."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    bad = found.select(F.col("doc_id").alias("bad_id"), "text_hash").distinct()
    same = F.col(f"c{names.index(doc_id)}").eqNullSafe(F.col("bad_id")) & (F.xxhash64(f"c{names.index(text)}") == F.col("text_hash"))
    return plain.join(bad, same, "left_anti").toDF(*names)
