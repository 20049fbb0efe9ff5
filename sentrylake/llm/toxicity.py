"""Toxicity by two Kneser-Ney models of letters, of toxic and of ordinary texts, over shared lower orders.

Each class has its own counts of the orders above ``SHARED``: of the highest order how often an n-gram
occurs, of the others how many letters the class has seen before it. Below, both back off to one
distribution, from the n-gram types of both together. So a rare expression doesn't speak for the class
that happens to have more text; only what one class says more often than the other expects does.

The score of a text compares both log-likelihoods, divided by the letters they are of, over the whole text and
word by word. Of the words the ``MOST`` most toxic count by their mean, less what those of an ordinary text with
as many words are expected to have: a long text is as toxic as its worst words, not as its average, but isn't
more toxic for having more words. Both classes are as likely beforehand, whatever their shares of the labels.

N-grams and contexts are kept in tables that grow with their number: shards written by tasks to the shared
folder, which scoring tasks map. Each entry carries 32 bits of its key besides those that say where it stands.
"""

from __future__ import annotations

import uuid
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.llm.common import frugal, give_back, load_array, mix, pick, write_array
from sentrylake.llm.letters import BITS, grams, streams
from sentrylake.session import materialize, scratch_path

ORDER, SHARED, DISCOUNT = 5, 2, 0.9
#: So many words of a text speak for it; a word of more letters than ``LONGEST`` (no blanks) counts as several.
MOST, LONGEST = 5, 16
#: Score from which a text is toxic.
REJECT = 0.7
#: Entries of a shard of a table, about; a larger table has more shards.
SHARD = 1 << 22
#: At most one in so many distinct training texts fits the scale of the score, and about so many of them at most.
SCALE_EVERY, SCALE_ROWS = 8, 20_000
#: Slope and middle that the fit starts from and stays near when there are few rows.
SLOPE, MIDDLE = 2.0, 5.0
#: About so many labelled rows at most are learned from, drawn by a hash of the id; what is sent to every executor.
LABELLED = 1 << 22
#: Symbols that a task gathers before it adds them up; a memory bound.
_AT_ONCE = 1 << 20
#: Counts of all rows, and of all but those that fit the scale.
CLASSES, LESS = ("toxic", "ordinary"), ("toxic_less", "ordinary_less")


class Table(NamedTuple):
    bits: int  # of an entry's hash that name its shard
    shards: tuple[str, ...]  # arrays in the shared folder; empty: a shard without entries


class Model(NamedTuple):
    ratios: Table  # n-grams that a class has
    contexts: Table  # contexts that a class has
    growth: float  # of an ordinary text's most toxic words with the logarithm of the number of words
    usual: float  # the logarithm from which that growth counts
    slope: float
    whole: float  # slope of the ratio of the whole text
    middle: float


def _hash(keys: np.ndarray, level: int | np.ndarray) -> np.ndarray:
    """64 bits, different for different keys or levels."""
    return mix((keys.astype(np.uint64) << np.uint64(3)) | np.asarray(level, np.uint64))


def _text_grams(text: str | None) -> np.ndarray:
    parts = [grams(s, ORDER) for s in streams(text or "", ORDER - 1, ORDER - 1)]
    return np.concatenate([np.zeros(0, np.int64), *parts])


def counts(labelled: DataFrame) -> DataFrame:
    """``g`` and counts: n-grams of all rows of ``text, toxic, aside``; tasks add up their own before the shuffle.

    ``toxic, ordinary`` are those of all rows, ``toxic_less, ordinary_less`` those of rows that aren't set aside.
    """

    def run(batches):
        held: dict[tuple[int, bool], list[np.ndarray]] = {(label, aside): [] for label in (0, 1) for aside in (False, True)}
        size = 0

        def made():
            keys, sums = [], []
            for (label, aside), parts in held.items():
                u, n = np.unique(np.concatenate([np.zeros(0, np.int64), *parts]), return_counts=True)
                keys.append(u)
                sums.append([n * (label == of) * (not (aside and less)) for less in (False, True) for of in (1, 0)])
                parts.clear()
            columns = [np.concatenate(keys), *(np.concatenate([s[k] for s in sums]) for k in range(4))]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["g", *CLASSES, *LESS])

        for batch in batches:
            for text, label, aside in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                g = _text_grams(text.as_py())
                held[int(label == 1), bool(aside)].append(g)
                size += len(g)
                if size >= _AT_ONCE:
                    yield made()
                    size = 0
        yield made()

    found = labelled.select("text", "toxic", "aside").mapInArrow(frugal(run), "g long, toxic long, ordinary long, toxic_less long, ordinary_less long")
    return found.groupBy("g").agg(*[F.sum(c).alias(c) for c in (*CLASSES, *LESS)])


def _suffix(c: str, k: int) -> Column:
    return F.col(c).bitwiseAND(F.lit((1 << BITS * k) - 1))


def _shared(levels: dict[int, DataFrame]) -> DataFrame:
    """``key`` and a chance for each class, all alike: interpolated Kneser-Ney of order ``SHARED`` from the types of both classes."""
    total = levels[1].agg(F.coalesce(F.sum("types"), F.lit(1))).first()[0]
    p = levels[1].select("key", (F.col("types") / total).alias("p"))
    for k in range(2, SHARED + 1):
        level = levels[k].withColumn("context", F.shiftright("key", BITS)).withColumn("low", _suffix("key", k - 1))
        sums = level.groupBy("context").agg(F.sum("types").alias("sum"), F.count("*").alias("kinds"))
        below = p.select(F.col("key").alias("low"), F.col("p").alias("p_low"))
        chance = (F.col("types") - DISCOUNT + DISCOUNT * F.col("kinds") * F.col("p_low")) / F.col("sum")
        p = level.join(sums, "context").join(below, "low").select("key", chance.alias("p"))
    return p.select("key", *[F.col("p").alias(f"p_{c}") for c in (*CLASSES, *LESS)])


def log_ratios(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``level, key, n, ratio, n_less, ratio_less`` of the n-grams of each class order, and of their contexts.

    ``less`` is without the rows set aside: an n-gram that only they have gets what backing off gives. The ratio of a context is that of the shares which the classes leave to the order below; an n-gram that
    neither class has adds it and goes on there.
    """
    classes = (*CLASSES, *LESS)

    def compared(name: str, end: str = "") -> list[Column]:
        """``n`` and ``ratio`` of all rows and of those not set aside."""
        both = ((CLASSES, ""), (LESS, "_less"))
        return [x for (t, o), as_ in both for x in ((F.col(f"{t}{end}") + F.col(f"{o}{end}")).alias(f"n{as_}"), F.log(F.col(name.format(t)) / F.col(name.format(o))).alias(f"ratio{as_}"))]

    levels = {ORDER: found.select(F.col("g").alias("key"), *classes, F.lit(1).alias("types"))}
    for k in range(ORDER - 1, 0, -1):
        seen = [F.count(F.when(F.col(c) > 0, 1)).alias(c) for c in classes]
        levels[k] = materialize(levels[k + 1].groupBy(_suffix("key", k).alias("key")).agg(*seen, F.count("*").alias("types")), "ngram-level")
    below, ratios, rests = _shared(levels), [], []
    for k in range(SHARED + 1, ORDER + 1):
        level = levels[k].withColumn("context", F.shiftright("key", BITS)).withColumn("low", _suffix("key", k - 1))
        contexts = level.groupBy("context").agg(
            *[F.sum(c).alias(f"{c}_sum") for c in classes], *[F.count(F.when(F.col(c) > 0, 1)).alias(f"{c}_kinds") for c in classes],
        )
        for c in classes:
            contexts = contexts.withColumn(f"{c}_rest", F.when(F.col(f"{c}_sum") > 0, DISCOUNT * F.col(f"{c}_kinds") / F.col(f"{c}_sum")).otherwise(1.0))
        own = {c: F.when(F.col(f"{c}_sum") > 0, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(f"{c}_sum")).otherwise(0.0) for c in classes}
        chances = [(own[c] + F.col(f"{c}_rest") * F.col(f"p_{c}")).alias(f"p_{c}") for c in classes]
        level = level.join(contexts, "context").join(below.withColumnRenamed("key", "low"), "low")
        below = materialize(level.select("key", *classes, *chances), "ngram-chances")
        ratios.append(below.select(F.lit(k).alias("level"), "key", *compared("p_{}")))
        below = below.drop(*classes)
        rests.append(contexts.select(F.lit(k).alias("level"), F.col("context").alias("key"), *compared("{}_rest", "_sum")))
    return reduce(DataFrame.unionByName, ratios), reduce(DataFrame.unionByName, rests)


def _packed(h: np.ndarray, values: list[np.ndarray]) -> np.ndarray:
    """A shard: bits of a bucket, where each bucket begins, 32 further bits of each entry's hash, its values."""
    bits = max(4, int(max(1, len(h)) - 1).bit_length())
    order = np.argsort(h)
    h = h[order]
    starts = np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.uint32)
    check = ((h << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
    return np.concatenate([np.array([bits], np.uint32), starts, check, *[v[order].astype(np.float32).view(np.uint32) for v in values]])


def look_up(table: Table, which: int, keys: np.ndarray, level: int) -> np.ndarray:
    """Of each key its value in the table, NaN if it has none; ``which``: 0 of all rows, 1 of those not set aside."""
    out, h = np.full(len(keys), np.nan, np.float32), _hash(keys, level)
    shard = (h >> np.uint64(64 - table.bits)).astype(np.int64) if table.bits else None
    for at, uri in enumerate(table.shards):
        own = np.arange(len(h)) if shard is None else np.flatnonzero(shard == at)
        if not uri or not len(own):
            continue
        packed = load_array(uri)
        bits = int(packed[0])
        size = (len(packed) - (1 << bits) - 2) // 3
        starts, check, values = packed[1 : (1 << bits) + 2], packed[(1 << bits) + 2 :][:size], packed[(1 << bits) + 2 + size * (1 + which) :][:size].view(np.float32)
        rest = h[own] << np.uint64(table.bits)
        bucket, wanted = (rest >> np.uint64(64 - bits)).astype(np.int64), ((rest << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
        place, end = starts[bucket].astype(np.int64), starts[bucket + 1].astype(np.int64)
        left = np.flatnonzero(place < end)
        while len(left):
            here = place[left]
            hit = check[here] == wanted[left]
            out[own[left[hit]]] = values[here[hit]]
            left = left[~hit]
            place[left] += 1
            left = left[place[left] < end[left]]
    return out


def _table(rows: DataFrame) -> Table:
    """The table of ``level, key, n, ratio, n_less, ratio_less``; tasks write its shards, the driver gets their names."""
    spark = rows.sparkSession
    rows = materialize(rows.select("level", "key", "ratio", F.when(F.col("n_less") > 0, F.col("ratio_less")).alias("less")), "letter-model-rows")
    bits = max(0, int(rows.count() - 1) // SHARD).bit_length()
    folder = scratch_path(spark, "letter-model")

    def hashed(batches):
        for batch in batches:
            h = _hash(batch.column(1).to_numpy(), batch.column(0).to_numpy())
            shard = (h >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(h), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(h.view(np.int64), pa.int64()), *batch.columns[2:]], ["shard", "h", "ratio", "less"])

    def written(group: pa.Table) -> pa.Table:
        h = group["h"].to_numpy().view(np.uint64)
        values = [group[c].to_pandas().to_numpy(np.float32) for c in ("ratio", "less")]
        h = h << np.uint64(bits)
        uri = write_array(f"{folder}-{uuid.uuid4().hex}.npy", _packed(h, values))
        return pa.table({"shard": group["shard"][:1], "uri": pa.array([uri], pa.string())})

    shards = rows.mapInArrow(frugal(hashed), "shard int, h long, ratio double, less double")
    made = dict(shards.groupBy("shard").applyInArrow(written, "shard int, uri string").collect())  # one short row a shard
    return Table(bits, tuple(made.get(at, "") for at in range(1 << bits)))


def evidence(text: str | None, ratios: Table, contexts: Table, which: int = 0) -> tuple[float, float, int]:
    """Mean log-likelihood ratio of the ``MOST`` most toxic words (of all, if fewer), that of a letter, and the number of words.

    A word's ratio is the sum of those of its letters and of the blank behind it. A text without letters has 0s.
    """
    top, total, letters, words, begun, length = np.zeros(0), 0.0, 0, 0, 0.0, 0
    for s in streams(text or "", ORDER - 1, ORDER - 1):
        g = grams(s, ORDER)
        if not len(g):
            continue
        value, left = np.zeros(len(g)), np.arange(len(g))
        for k in range(ORDER, SHARED, -1):
            key = g[left] & ((1 << BITS * k) - 1)
            ratio = look_up(ratios, which, key, k)
            unseen = np.isnan(ratio)
            value[left[~unseen]] += ratio[~unseen]
            left = left[unseen]
            if not len(left):
                break
            value[left] += np.nan_to_num(look_up(contexts, which, key[unseen] >> BITS, k))
        total, letters = total + value.sum(), letters + len(g)
        blank = (g & ((1 << BITS) - 1)) == 0
        since = np.arange(len(g)) + length  # letters of the word so far
        since -= np.maximum.accumulate(np.where(np.concatenate([[False], blank[:-1]]), since, 0))
        ends = np.flatnonzero(blank | (since % LONGEST == LONGEST - 1))
        sums = np.diff(np.concatenate([[0.0], np.cumsum(value)[ends]]))
        if len(ends):
            sums[0] += begun
            words += len(ends)
            top = -np.sort(-np.concatenate([top, sums]))[:MOST]
        begun = (0.0 if len(ends) else begun) + value[ends[-1] + 1 if len(ends) else 0 :].sum()
        length = 0 if blank[-1] else int(since[-1]) + 1
    return float(top.mean()) if len(top) else 0.0, float(total / max(1, letters)), max(1, words)


def _fit_growth(best: np.ndarray, words: np.ndarray) -> tuple[float, float]:
    """How the most toxic words of ordinary texts grow with the logarithm of their number of words, at least 0, and from where."""
    if not len(best):
        return 0.0, 0.0
    x = np.log(words)
    usual = float(x.mean())
    return max(0.0, float((x - usual) @ (best - best.mean()) / ((x - usual) @ (x - usual) + 1.0))), usual


def _fit_scale(values: np.ndarray, labels: np.ndarray, whole: np.ndarray) -> tuple[float, float, float]:
    """Slopes of the most toxic words and of the whole text, and middle, of a logistic curve (Newton's method).

    Both classes weigh as much together. The values are pulled toward ``SLOPE``, 0 and ``MIDDLE``; a whole text is
    never less toxic for a higher ratio.
    """
    start = np.array([SLOPE, 0.0, -SLOPE * MIDDLE])
    every = np.stack([values, whole, np.ones_like(values)], 1)
    toxic = int(labels.sum())
    share = np.where(labels == 1, max(1, toxic), max(1, len(labels) - toxic))
    weight = len(values) / 2 / share * min(1.0, 1000 / max(1, len(values)))  # a large sample doesn't drown the pull
    for used in ([0, 1, 2], [0, 2]):
        x, w = every[:, used], start[used]
        pull = np.diag([0.05] * len(used))

        def loss(w: np.ndarray) -> float:
            return float(weight @ (np.logaddexp(0.0, x @ w) - labels * (x @ w)) + (w - start[used]) @ pull @ (w - start[used]) / 2)

        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
            gradient = x.T @ (weight * (p - labels)) + pull @ (w - start[used])
            step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + pull, gradient)
            while loss(w - step) > loss(w) and np.abs(step).max() >= 1e-9:  # a whole step may go too far
                step = step / 2
            if np.abs(step).max() < 1e-9:
                break
            w = w - step
        if len(used) == 2 or w[1] >= 0:
            break
    slope, more = float(w[0]), float(w[1]) if len(used) == 3 else 0.0
    return (slope, more, float(-w[-1] / slope)) if slope > 0.5 else (SLOPE, 0.0, MIDDLE)


def fit(labelled: DataFrame) -> Model:
    """The model of all rows of ``text, toxic`` (0 or 1; other labels are left out), also with ``text_hash``.

    All rows are counted. The scale of the score is that of about ``SCALE_ROWS`` distinct texts, and of at most
    one in ``SCALE_EVERY``, drawn by a hash: they are scored by the model of the other rows. Without rows of one
    class every score is that of a text about which both models say the same.
    """
    h = F.col("text_hash") if "text_hash" in labelled.columns else F.xxhash64("text", F.lit(5))
    rows = labelled.select("text", "toxic", h.alias("h")).where("toxic in (0, 1)")
    kinds = rows.agg(F.approx_count_distinct("h", 0.02)).first()[0]
    aside = F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * min(1 / SCALE_EVERY, SCALE_ROWS / max(1, kinds)))
    found = materialize(counts(rows.withColumn("aside", aside)), "ngram-counts")
    ratios, rests = (_table(x) for x in log_ratios(found))
    drawn = rows.where(aside).dropDuplicates(["h", "toxic"])
    drawn = drawn.select(_evidence(ratios, rests, 1)("text").alias("e"), "toxic").select("e.*", "toxic").toPandas()
    best, whole, words, labels = (drawn[c].to_numpy(float) for c in ("best", "whole", "words", "toxic"))
    growth, usual = _fit_growth(best[labels == 0], words[labels == 0])
    return Model(ratios, rests, growth, usual, *_fit_scale(best - growth * (np.log(words) - usual), labels, whole))


def _evidence(ratios: Table, contexts: Table, which: int):
    @F.pandas_udf("best double, whole double, words long")
    def value(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([evidence(x, ratios, contexts, which) for x in text], columns=["best", "whole", "words"])

    return value


def score(model: Model, text: str | Column = "text") -> Column:
    """Toxicity from 0 to 1 of a column of whole texts; null texts and those without letters have that of no evidence."""
    ratios, contexts, growth, usual, slope, more, middle = model

    @F.pandas_udf("double")
    def run(text: pd.Series) -> pd.Series:
        found = np.array([evidence(x, ratios, contexts) for x in text], float).reshape(-1, 3)
        give_back()
        excess = found[:, 0] - growth * np.where(found[:, :2].any(1), np.log(found[:, 2]) - usual, 0.0)
        return pd.Series(1.0 / (1.0 + np.exp(-np.clip(slope * (excess - middle) + more * found[:, 1], -500, 500))))

    return run(text)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether the CRC-32 of an id's text falls in this part of so many; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, parts: int = 3, part: int = 1, most: int = LABELLED) -> DataFrame:
    """``text, toxic, text_hash`` of the labelled documents that aren't held out; of several labels of one id the highest.

    Rows with a null id or another label are left out, repeated documents are learned each. Of more than
    ``most`` labelled ids about ``most`` count, drawn by a hash of the id. They are sent to where the documents
    lie, which is why their number is bounded; no text is shuffled.
    """
    texts = pick(docs, doc_id="doc_id", text="text").where(~held_out(F.col("doc_id"), parts, part)).withColumn("text_hash", F.xxhash64("text", F.lit(5)))
    known = pick(labels, doc_id="doc_id", toxic="toxic").where("toxic in (0, 1)").where(~held_out(F.col("doc_id"), parts, part))
    known = materialize(known.groupBy("doc_id").agg(F.max("toxic").cast("byte").alias("toxic")), "labels")
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / max(1, known.count())))
    return texts.join(F.broadcast(known.where(drawn)), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"), "text_hash")
