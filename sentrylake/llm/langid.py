"""Language by the nearest of several centroids of each language, among TF-IDF vectors of letter n-grams."""

from __future__ import annotations

from collections import Counter, defaultdict
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.llm.common import frugal, give_back, mix, partitions
from sentrylake.llm.letters import grams, streams
from sentrylake.session import materialize

#: Vectors have so many components; n-grams of one to three letters share them by a hash.
SIZE, ORDERS = 1 << 13, (1, 2, 3)
#: Centroids of a language, rounds of their search, and the most documents (about) that a language gives to it.
CENTROIDS, ROUNDS, SAMPLE = 8, 12, 2000
#: A text whose nearest centroid has a cosine below is in none of the languages, whatever its radius.
NEAREST = 0.05
#: The radius of a language is so much of the cosine that this share of its rows stays below; fewer pieces teach none.
#: It is learned apart for texts of as many components (by powers of two), also from the first letters of each row.
SLACK, LOW, LEAST = 0.5, 0.01, 50
PIECES, BANDS, BINS = (8, 32, 128, 512), SIZE.bit_length(), 512
UNKNOWN = "und"


class Model(NamedTuple):
    idf: np.ndarray
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # unit vectors
    radii: np.ndarray  # least cosine by centroid and band


def counts(text: str | None) -> np.ndarray:
    """Times each component's n-grams occur in a whole text; all 0 without letters."""
    out = np.zeros(SIZE, np.int64)
    most = max(ORDERS)
    for s in streams(text or "", most - 1, most - 1):
        for n in ORDERS:
            g = grams(s[most - n :], n)  # every n-gram that ends behind the symbols repeated from the slice before
            g = g[g != 0]
            out += np.bincount((mix(g.astype(np.uint64) * np.uint64(4) + np.uint64(n)) & np.uint64(SIZE - 1)).astype(np.int64), minlength=SIZE)
    return out


def vector(text: str | None, idf: np.ndarray) -> np.ndarray:
    """Unit vector of damped counts times inverse document frequencies; 0 without letters."""
    v = np.log1p(counts(text)).astype(np.float32) * idf
    length = np.sqrt(float(v @ v))
    return v / length if length else v


def document_frequencies(texts: DataFrame) -> DataFrame:
    """``component, n`` over all rows, and a row with component -1 for their number; tasks add up their own."""

    def run(batches):
        total, rows = np.zeros(SIZE, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                total += counts(text.as_py()) > 0
                rows += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int32()), pa.array([rows, *total[at]], pa.int64())], ["component", "n"])

    return texts.select("text").mapInArrow(frugal(run), "component int, n long").groupBy("component").agg(F.sum("n").alias("n"))


def cluster(rows: list[tuple[np.ndarray, np.ndarray]], k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of at most ``k`` clusters by cosine, begun from vectors far from each other.

    Each row has the components of a unit vector that aren't 0, and their values: a text has few of ``SIZE``.
    """

    def cosines(centroids: np.ndarray) -> np.ndarray:
        return np.stack([centroids[:, at] @ value for at, value in rows])

    def whole(i: int) -> np.ndarray:
        out = np.zeros(SIZE)
        out[rows[i][0]] = rows[i][1]
        return out

    total = np.zeros(SIZE)
    for at, value in rows:
        total[at] += value
    chosen = [whole(int(np.argmax(cosines(total[None]))))]
    nearest = cosines(chosen[0][None])[:, 0]
    while len(chosen) < min(k, len(rows)):
        chosen.append(whole(int(np.argmin(nearest))))
        nearest = np.maximum(nearest, cosines(chosen[-1][None])[:, 0])
    centroids = np.stack(chosen)
    for _ in range(rounds):
        own = np.argmax(cosines(centroids), 1)
        sums = np.where(np.isin(np.arange(len(centroids)), own)[:, None], 0.0, centroids)
        for j, (at, value) in zip(own, rows, strict=True):
            sums[j, at] += value
        centroids = np.stack([s / max(np.sqrt(float(s @ s)), 1e-12) for s in sums])
    return centroids.astype(np.float32)


def band(v: np.ndarray) -> int:
    """How rich a vector is: a text of few components, short or repetitive, is far from every centroid."""
    return max(0, int(np.count_nonzero(v)).bit_length() - 1)


def radii(known: DataFrame, idf: np.ndarray, languages: list[str], centroids: np.ndarray) -> np.ndarray:
    """The least cosine of each centroid's language in each band, from all rows of ``text, lang`` and their beginnings.

    Tasks count cosines in ``BINS`` steps, so the driver gets at most that many numbers for each language and band.
    A band in which a language has fewer than ``LEAST`` pieces takes the lowest radius of the others, or, as the
    richest bands do, that of the band below.
    """
    own = {x: centroids[[i for i, y in enumerate(languages) if x == y]] for x in set(languages)}

    def run(batches):
        found: Counter = Counter()
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if lang not in own:
                    continue
                whole = text.as_py()
                for part in (whole, *(whole[:k] for k in PIECES if k < len(whole))):
                    v = vector(part, idf)
                    if v.any():
                        found[lang, band(v), int(BINS * max(0.0, float((own[lang] @ v).max())))] += 1
        columns = list(zip(*[(*key, n) for key, n in found.items()], strict=True)) or [[]] * 4
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["lang", "band", "bin", "n"])

    steps = known.select("text", "lang").mapInArrow(frugal(run), "lang string, band int, bin int, n long").groupBy("lang", "band", "bin").agg(F.sum("n").alias("n"))
    held = defaultdict(list)
    for r in steps.collect():
        held[r["lang"], r["band"]].append((r["bin"], r["n"]))
    least: dict = {}
    for key, pairs in held.items():
        at, n = np.array(sorted(pairs)).T
        if n.sum() >= LEAST:
            least[key] = SLACK * at[np.searchsorted(np.cumsum(n), LOW * n.sum())] / BINS
    out = np.zeros((len(languages), BANDS), np.float32)
    for b in range(BANDS):
        others = [x for (_, c), x in least.items() if c == b]
        for i, lang in enumerate(languages):
            out[i, b] = least.get((lang, b), min(others) if others else out[i, b - 1] if b else 0.0)
    return out


def sparse_vectors(drawn: DataFrame, idf: np.ndarray) -> DataFrame:
    """``lang, nth, at, value``: components that aren't 0 of each text's vector, the texts of a language numbered in their order.

    Texts without letters are left out. No text gets to the task that clusters, whatever its length.
    """

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch, found = whole.slice(start, 256), []
                for i, text in enumerate(batch.column(2)):
                    v = vector(text.as_py(), idf)
                    at = np.flatnonzero(v)
                    if len(at):
                        found.append((i, at.astype(np.uint16).tobytes(), v[at].astype(np.float64).tobytes()))
                rows = batch.select([0, 1]).take(pa.array([x[0] for x in found], pa.int64()))
                packed = [pa.array([x[k] for x in found], pa.binary()) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *packed], ["lang", "nth", "at", "value"])

    numbered = drawn.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("text"))).select("lang", "nth", "text")
    return numbered.repartition(partitions(drawn), "lang", "nth").mapInArrow(frugal(run), "lang string, nth int, at binary, value binary")


def fit(known: DataFrame, centroids: int = CENTROIDS, sample: int = SAMPLE) -> Model:
    """The model of rows of ``text, lang``; rows without a language or without letters teach nothing.

    Document frequencies are those of all rows. The centroids of a language are those of about ``sample`` of
    its distinct texts, drawn by their hash: this bounds what one task clusters, however many copies there are. Its radii are those of all
    rows. The driver gets ``SIZE`` frequencies and ``centroids`` vectors for each language, and so does every task.
    """
    known = known.select("text", "lang").where("text is not null and lang is not null")
    frequencies = {r["component"]: r["n"] for r in document_frequencies(known).collect()}
    n = frequencies.pop(-1, 0)
    df = np.zeros(SIZE)
    df[list(frequencies)] = list(frequencies.values())
    idf = (np.log((1 + n) / (1 + df)) + 0.1).astype(np.float32)

    hashed = known.withColumn("h", F.xxhash64("text", F.lit(3)))
    kinds = hashed.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()
    shares = [x for r in kinds for x in (F.lit(r["lang"]), F.lit(sample / r["n"]))]
    chance = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    drawn = hashed.where(chance < F.create_map(*shares)[F.col("lang")]) if shares else hashed
    drawn = materialize(drawn.dropDuplicates(["lang", "h"]).drop("h"), "language-sample")

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("nth")
        found = cluster([(np.frombuffer(at, np.uint16), np.frombuffer(value)) for at, value in zip(pdf["at"], pdf["value"], strict=True)], centroids)
        give_back()
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]] * len(found), "centroid": [c.tobytes() for c in found]})

    learned = sparse_vectors(drawn, idf).groupBy("lang").applyInPandas(learn, "lang string, centroid binary").collect()
    learned.sort(key=lambda r: (r["lang"], bytes(r["centroid"])))
    rows = [np.frombuffer(bytes(r["centroid"]), np.float32) for r in learned]
    languages, found = [r["lang"] for r in learned], np.stack(rows) if rows else np.zeros((0, SIZE), np.float32)
    return Model(idf, languages, found, radii(known, idf, languages, found))


def predict(model: Model, text: str | Column = "text", nearest: float = NEAREST) -> Column:
    """``struct<lang_pred, score, rejected>`` of a column of whole texts.

    ``lang_pred`` is the language of the nearest centroid and ``score`` its cosine; ``und`` and 0 for a text
    that is null or has no letter, or if no language was learned. ``rejected``: those, and texts whose
    nearest centroid is farther than its radius for texts as rich, or than a cosine of ``nearest``.
    """

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            v = vector(text, model.idf)
            if not len(model.languages) or not any(map(str.isalpha, text or "")):
                out.append((UNKNOWN, 0.0, True))
                continue
            cosines = model.centroids @ v
            best = int(np.argmax(cosines))
            score = float(min(1.0, max(0.0, cosines[best])))
            out.append((model.languages[best], score, score < max(nearest, model.radii[best, band(v)])))
        give_back()
        return pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])

    return run(text)
