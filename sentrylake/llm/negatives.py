"""Hard negatives by a threshold join on inner products: a pruned index of rows in blocks, thresholds lowered until windows fill.

A window asks for an anchor's best rows between a floor and a ceiling, of its own label or of the others.
Windows start at a threshold which a sample of the rows says to be near their last place, so that most of
the index is left out and most pairs are pruned; windows that don't fill are asked again with a lower
threshold, in the end with their floor, so results are exact whatever the sample says.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.llm.common import open_fs, pick
from sentrylake.session import materialize

#: Components are multiplied by this and rounded down.
SCALE = 256
#: Rows of an index block and anchors that are held against it at a time.
BLOCK, ANCHORS = 1 << 13, 256
#: Dimensions accumulated between two prunings.
STEP = 8
#: One row in so many is in the sample that first thresholds come from.
SAMPLE = 64
#: Inner products stay exact below this product of norms.
_EXACT = 2.0**52

_FOUND = "wid long, row long, vec_id long, score long"


def usable(embeddings: DataFrame) -> DataFrame:
    """``row, vec_id, label, x``: rows that take part, with whole-numbered components, numbered for identity.

    Left out are rows with a null id, label, vector or component, or one that isn't finite, and those whose
    squares add up to 2**62 or more, for which no score is sure to be a long. Repeated rows are rows of their
    own. A vector that ends early counts 0 beyond its end.
    """
    rows = pick(embeddings, vec_id="vec_id", label="label", x="embedding").where("vec_id is not null and label is not null and x is not null")
    rows = rows.selectExpr("cast(vec_id as long) as vec_id", "cast(label as long) as label", "transform(x, c -> cast(c as double)) as x")
    rows = rows.where("forall(x, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
    rows = rows.where(f"aggregate(x, 0D, (a, c) -> a + ({SCALE} * c + 1) * ({SCALE} * c + 1)) < {2.0**62}")
    rows = rows.selectExpr("vec_id", "label", f"transform(x, c -> cast(floor({SCALE} * c) as long)) as x")
    return rows.selectExpr("monotonically_increasing_id() as row", "*")


def _matrix(lists: pa.ListArray | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of one matrix, filled up with zeros; ``lists`` has no nulls."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Index:
    """Inverted index of a block of rows: for each dimension the rows that are listed there, as a matrix of postings.

    Rows stand in the order of how many of their leading dimensions are listed, so that the postings of a
    dimension are the first so many rows. A row's dimensions stop being listed where the norm of the rest is
    below ``least``: a query of norm 1 whose score with the row is ``least`` or more then meets a listed one.
    """

    def __init__(self, x: np.ndarray, least: float):
        square = x.astype(np.float64) ** 2
        rest = np.sqrt(np.maximum(np.cumsum(square[:, ::-1], axis=1)[:, ::-1], 0)) * (1 + 1e-12)
        rest = np.concatenate([rest, np.zeros((len(x), 1))], axis=1)  # norm from each dimension on
        listed = (rest >= least).argmin(axis=1) if least > 0 else np.full(len(x), x.shape[1])
        self.order = np.argsort(-listed, kind="stable")
        self.x, self.rest, self.listed = x[self.order].astype(np.float64), rest[self.order], listed[self.order]

    def candidates(self, queries: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``query, row, score`` of the pairs whose score is the query's ``least`` or more.

        Scores of listed dimensions are added up a few at a time; after each step a query's rows that can't
        make up for the rest, by the norms that remain of both, are left out.
        """
        n, width = self.x.shape
        own = np.sqrt(np.maximum(np.cumsum(queries[:, ::-1] ** 2, axis=1)[:, ::-1], 0)) * (1 + 1e-12)
        own = np.concatenate([own, np.zeros((len(queries), 1))], axis=1)
        score = np.zeros((len(queries), n))
        ends = [(n, 0)]  # rows up to here have been added up to there; the last entry counts first
        alive, at = None, 0
        while at < width:
            upto = min(width, at + STEP)
            some = int(np.searchsorted(-self.listed, -at, "left"))  # rows with a listed dimension from here on
            if not some:
                break
            score[:, :some] += queries[:, at:upto] @ self.x[:some, at:upto].T
            ends = [e for e in ends if e[0] > some] + [(some, upto)]
            at = upto
            if 4 * at >= width:
                alive = self._alive(score, own, ends, least)
                if np.count_nonzero(alive) * 8 < alive.size:
                    break
        alive = self._alive(score, own, ends, least) if alive is None or at >= width else alive
        q, r = np.nonzero(alive)
        total = score[q, r]
        begin = 0
        for end, done in reversed(ends):  # what was listed is in, the rest is added for the pairs left
            pairs = np.flatnonzero((r >= begin) & (r < end)) if done < width else np.zeros(0, np.int64)
            for part in np.array_split(pairs, 1 + len(pairs) * (width - done) // (1 << 21)) if len(pairs) else []:
                total[part] += np.einsum("ij,ij->i", queries[q[part], done:], self.x[r[part], done:])
            begin = end
        keep = total >= least[q]
        return q[keep], self.order[r[keep]], total[keep]

    def _alive(self, score: np.ndarray, own: np.ndarray, ends: list[tuple[int, int]], least: np.ndarray) -> np.ndarray:
        """Pairs that can still reach their threshold: what is added up, and the product of the norms that remain."""
        out, begin = np.empty(score.shape, bool), 0
        for end, done in reversed(ends):
            out[:, begin:end] = score[:, begin:end] + own[:, done, None] * self.rest[None, begin:end, done] >= least[:, None] - 0.5
            begin = end
        return out


def _exact_pairs(x: np.ndarray, queries: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for numbers too large for floating point, in whole numbers."""
    score = queries.astype(np.int64) @ x.T
    q, r = np.nonzero(score >= least[:, None])
    return q, r, score[q, r]


def _best(window: np.ndarray, score: np.ndarray, ids: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Places of each window's first ``want`` pairs: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, window))
    w = window[order]
    rank = np.arange(len(w)) - np.searchsorted(w, w, "left")
    return order[rank < want[w]]


def _search(files: list[str], width: int, order: list[int]):
    """For blocks of rows: what they have for the open windows, which are read from files a few anchors at a time."""
    import pyarrow.parquet as pq

    def one(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, labels, numbers = (rows[c].to_numpy() for c in ("vec_id", "label", "row"))
        x = _matrix(rows["x"], width)[:, order]
        norm = float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))
        built: dict[float, Index] = {}
        for path in files:
            fs, name = open_fs(path)
            with fs.open_input_file(name) as f:
                for batch in pq.ParquetFile(f).iter_batches(ANCHORS):
                    yield from against(batch, x, norm, ids, labels, numbers, built)

    def against(batch, x, norm, ids, labels, numbers, built) -> Iterator[pa.RecordBatch]:
        whole = _matrix(batch.column("x"), width)[:, order]
        a_label, a_row = batch.column("label").to_numpy(), batch.column("row").to_numpy()
        of = np.repeat(np.arange(len(batch)), np.diff(batch.column("windows").offsets.to_numpy()))
        w = batch.column("windows").flatten()
        wid, low, high, want, alike = (w.field(c).to_numpy(zero_copy_only=False) for c in ("wid", "threshold", "ceiling", "want", "alike"))
        least = np.full(len(batch), np.iinfo(np.int64).max)
        np.minimum.at(least, of, low)
        norms = np.sqrt((whole.astype(np.float64) ** 2).sum(axis=1)) + 1e-9
        if norm * norms.max() >= _EXACT:
            pairs = _exact_pairs(x, whole, least)
        else:
            # one index serves all anchors whose thresholds are as high, in steps of a fourth of a doubling
            needed = max(0.0, float((least / norms).min()))
            level = 0.0 if needed < 1 else float(2.0 ** (np.floor(4 * np.log2(needed)) / 4))
            if level not in built:
                built.clear()
                built[level] = Index(x, level)
            pairs = built[level].candidates(whole.astype(np.float64), least.astype(np.float64))
        q, r, score = pairs
        other = numbers[r] != a_row[q]
        q, r, score = q[other], r[other], score[other].astype(np.int64)
        own = labels[r] == a_label[q]
        # each pair meets the windows of its anchor
        first, count = np.searchsorted(of, np.arange(len(batch)), "left"), np.bincount(of, minlength=len(batch))
        for j in range(int(count.max(initial=0))):
            has = count[q] > j
            pq_, pr, ps, po = q[has], r[has], score[has], own[has]
            pw = first[pq_] + j
            fits = (ps >= low[pw]) & (ps <= high[pw]) & (po == alike[pw])
            pw, pr, ps = pw[fits], pr[fits], ps[fits]
            top = _best(pw, ps, ids[pr], want)
            if len(top):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(wid[pw[top]], pa.int64()), pa.array(numbers[pr[top]], pa.int64()), pa.array(ids[pr[top]], pa.int64()), pa.array(ps[top], pa.int64())],
                    names=["wid", "row", "vec_id", "score"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= BLOCK:
                yield from one(pa.Table.from_batches(held))
                held = []
        if sum(map(len, held)):
            yield from one(pa.Table.from_batches(held))

    return run


def _top(found: DataFrame, want: int) -> DataFrame:
    """Each window's first ``want`` rows: higher scores first, then smaller ids."""
    w = Window.partitionBy("wid").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= want)


def _ask(rows: DataFrame, anchors: DataFrame, windows: DataFrame, want: int, shape: tuple[int, list[int]], name: str) -> DataFrame:
    """``wid, row, vec_id, score, rank``: what ``rows`` have for ``windows`` from their thresholds up, the first ``want``."""
    one = F.struct("wid", "threshold", "ceiling", F.lit(want).alias("want"), "alike")
    asked = windows.groupBy("a_row").agg(F.sort_array(F.collect_list(one)).alias("windows"), F.min("threshold").alias("least"))
    asked = anchors.join(asked, anchors["row"] == asked["a_row"]).select("row", "label", "x", "windows", "least")
    # a task opens all of these files, so there are few; anchors of like thresholds share an index
    files = max(1, windows.count() >> 17)
    asked = materialize(asked.repartition(files).sortWithinPartitions("least").drop("least"), f"{name}-windows")
    return materialize(_top(rows.mapInArrow(_search(sorted(asked.inputFiles()), *shape), _FOUND), want), name)


def fill_windows(rows: DataFrame, anchors: DataFrame, windows: DataFrame, want: int, name: str) -> DataFrame:
    """``wid, row, vec_id, score, rank`` of the best ``want`` rows of each window, or all that it has.

    ``rows`` and ``anchors`` are as from ``usable``; ``windows`` has ``wid, a_row, floor, ceiling, alike``: scores
    with the anchor ``a_row`` from floor to ceiling, of rows of its label or of others, never the anchor itself.
    A window of which the sample holds ``want`` rows has their last score as a sure threshold, and their best
    as a bold one, which comes first; others end with their floor.
    """
    size = rows.agg(F.max(F.size("x"))).first()[0]
    if size is None:
        return rows.sparkSession.createDataFrame([], _FOUND + ", rank int")
    size = max(1, size)  # of empty vectors only, all scores are 0
    sample = rows.where(f"pmod(xxhash64(row), {SAMPLE}) = 0")
    energy = dict(sample.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.sum(F.col("v").cast("double") * F.col("v"))).collect())
    shape = size, sorted(range(size), key=lambda d: (-(energy.get(d) or 0.0), d))
    seen = _ask(sample, anchors, windows.withColumn("threshold", F.col("floor")), want, shape, f"{name}-sample")
    seen = seen.groupBy("wid").agg(F.max("score").alias("bold"), F.min("score").alias("last"), F.count("*").alias("n"))
    open_ = windows.join(seen, "wid", "left").select(
        *windows.columns, F.coalesce("bold", "floor").alias("t0"), F.when(F.col("n") == want, F.col("last")).otherwise(F.col("floor")).alias("t1"), F.col("floor").alias("t2"))
    open_, results = materialize(open_, f"{name}-open"), []
    for rung in range(3):
        asked = open_.withColumn("threshold", F.col(f"t{rung}"))
        got = _ask(rows, anchors, asked, want, shape, f"{name}-{rung}")
        counts = got.groupBy("wid").agg(F.count("*").alias("n"))
        judged = asked.join(counts, "wid", "left").withColumn("filled", (F.coalesce("n", F.lit(0)) == want) | (F.col("threshold") == F.col("floor")))
        judged = materialize(judged.drop("n", "threshold"), f"{name}-judged")
        results.append(got.join(judged.where("filled").select("wid"), "wid", "left_semi"))
        open_ = judged.where("not filled").drop("filled")
        if not open_.take(1):
            break
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def mine(rows: DataFrame, positives: int = 5, negatives: int = 3) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` are as from ``usable``, with a column ``anchor``. An anchor's positives are its best other rows of its
    label; for each, its best rows of other labels that score from a half to 95 hundredths of the positive.
    A label of one row has no positives, a positive that scores below 0 no negatives; ties go to smaller ids.
    Repeated rows are rows of their own. Anchors are a stated query set, read in blocks by every block of rows.
    """
    anchors = materialize(rows.where("anchor").select("row", "vec_id", "label", "x"), "anchors")
    ask = anchors.selectExpr("row as wid", "row as a_row", f"cast({-(2**62)} as long) as floor", f"cast({2**62} as long) as ceiling", "true as alike")
    near = fill_windows(rows, anchors, ask, positives, "positives")
    near = materialize(near.selectExpr("monotonically_increasing_id() as pair", "wid as a_row", "vec_id as positive_id", "score as positive_score"), "positive-pairs")
    half, most = "positive_score div 2 + positive_score % 2", "cast(cast(positive_score as decimal(38, 0)) * 95 div 100 as long)"
    ask = near.where("positive_score >= 0").selectExpr("pair as wid", "a_row", f"{half} as floor", f"{most} as ceiling", "false as alike").where("floor <= ceiling")
    hard = fill_windows(rows, anchors, ask, negatives, "negatives")
    named = near.join(anchors.selectExpr("row as a_row", "vec_id as anchor_id"), "a_row")
    return hard.join(named, F.expr("wid = pair")).selectExpr(
        "anchor_id", "positive_id", "rank", "vec_id as negative_id", "positive_score", "score as negative_score"
    )
