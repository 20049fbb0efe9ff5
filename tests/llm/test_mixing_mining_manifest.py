"""Mixing, hard negatives and the Merkle manifest against brute force, on small and awkward tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sentrylake.llm import merkle, mixing, negatives
from sentrylake.llm.ranking import ranked


def test_ranks_of_a_hot_group(spark):
    rows = [("hot", i % 7, i) for i in range(300)] + [(None, 1, 1), (None, 0, 2), ("a", 5, 3)]
    got = ranked(spark.createDataFrame(rows, "g string, k int, id int"), ["g"], ["k", "id"], "r").collect()
    want = {}
    for g in ("hot", None, "a"):
        own = sorted(r[1:] for r in rows if r[0] == g)
        want |= {(g, *r): (i, len(own)) for i, r in enumerate(own)}
    assert {(r.g, r.k, r.id): (r.idx, r.n) for r in got} == want


# ---- 11


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 4)), min_size=1, max_size=5, unique_by=lambda x: x[0]), st.floats(0, 150))
def test_nearest_sum_equals_brute_force(lengths, budget):
    sizes, counts = (np.array(x) for x in zip(*lengths, strict=True))
    took = mixing.nearest_sum(sizes, counts, budget)
    assert (took >= 0).all() and (took <= counts).all()
    sums = {sum(s * k for s, k in zip(sizes, ks, strict=True)) for ks in itertools.product(*[range(c + 1) for c in counts])}
    assert abs((sizes * took).sum() - budget) == pytest.approx(min(abs(s - budget) for s in sums))


def by_hand(words, weights, most):
    """Targets by filling one source after the other."""
    order = sorted(words, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    stopped: set = set()
    while True:
        left, heavy = sum(words.values()) - most * sum(words[s] for s in stopped), sum(weight[s] for s in words if s not in stopped)
        goal = {s: most * words[s] if s in stopped else left * weight[s] / max(1, heavy) for s in words}
        more = {s for s in words if goal[s] > most * words[s] + 1e-9} - stopped
        if not more:
            return goal
        stopped |= more


@pytest.mark.parametrize("fitted", [50, 1 << 16])
def test_mix_meets_its_targets(spark, fitted):
    rng = random.Random(3)
    sources = ["b", "a", None, "é", "z", "tiny", ""]
    rows = [(i, rng.choice(sources[:5]) if i % 3 else "b", rng.choice([rng.randint(0, 40), 7, 500])) for i in range(700)]
    rows += [(9000, "tiny", 3), (9001, "", 0), (None, "z", 5), (None, "z", 5), (5, "z", None), (6, "b", 7), (6, "b", 7)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, size int, SOURCE_ string")
    got = mixing.mix(df, fitted=fitted).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, n or 0) for i, s, n in rows)
    words = Counter()
    for _, s, n in rows:
        words[s] += n or 0
    goal = by_hand(words, (5, 2, 1), 3)
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == words[r.source] and r.target == pytest.approx(goal[r.source])
        assert r.taken in {0, r.size, 2 * r.size, 3 * r.size}
    for s, n in words.items():
        assert abs(taken[s] - goal[s]) <= 1, (s, n)
    again = mixing.mix(df.repartition(5), fitted=fitted).collect()
    assert Counter((r.doc_id, r.source, r.taken) for r in again) == Counter((r.doc_id, r.source, r.taken) for r in got)


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, size long")
    assert mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, "a", 0), (2, None, None)], "doc_id long, source string, size long")
    assert [(r.taken, r.target) for r in mixing.mix(blank).collect()] == [(0, 0.0), (0, 0.0)]


def test_words(spark):
    texts = [None, "", " \x0b\t", "a  b\nc", "é x y", "w " * 50_000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.words_in(F.col("t"))).collect()
    assert [r[0] for r in got] == [0, 0, 0, 3, 2, 50_000]


# ---- 12


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 60), st.integers(1, 20), st.floats(-1.2, 1.2))
def test_index_equals_brute_force(seed, n, width, cosine):
    rng = np.random.default_rng(seed)
    x = np.floor(rng.standard_normal((n, width)) * rng.choice([0, 1, 30, 200], (n, 1))).astype(np.int64)
    q = np.floor(rng.standard_normal((5, width)) * 90).astype(np.int64)
    norms = np.sqrt((q**2).sum(axis=1)) + 1e-9
    least = np.floor(cosine * norms * 120)
    found = negatives.Index(x, max(0.0, float((least / norms).min()))).candidates(q.astype(float), least)
    score = q @ x.T
    want = {(i, j, score[i, j]) for i in range(5) for j in range(n) if score[i, j] >= least[i]}
    assert len(found[0]) == len(want) and set(zip(*[a.tolist() for a in found], strict=True)) == want


def hard_by_hand(rows, positives=5, wanted=3):
    """All pairs of anchors and rows."""
    out = Counter()
    good = [(i, v, l, [math.floor(256 * c) for c in x]) for i, (v, x, l) in enumerate(rows)
            if v is not None and l is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    for i, v, l, x in good:
        if v % 50:
            continue
        scored = [(-sum(a * b for a, b in zip(x, y, strict=False)), w, m) for j, w, m, y in good if j != i]
        for p, w, _ in sorted(s for s in scored if s[2] == l)[:positives]:
            hard = sorted(s for s in scored if s[2] != l and 50 * -p <= 100 * -s[0] <= 95 * -p)[:wanted]
            out.update((v, w, k + 1, h[1], -p, -h[0]) for k, h in enumerate(hard))
    return out


def vectors(kind):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((4, 12))
    rows = []
    for i in range(600):
        label = int(rng.integers(4))
        x = centres[label if i % 5 else int(rng.integers(4))] + 0.5 * rng.standard_normal(12)
        rows.append((i, [float(c) for c in x], label))
    hot = [float(c) for c in centres[0]]
    rows += [(1000 + i, hot, 0 if i % 4 else 2) for i in range(200)]  # one vector in many rows of two labels
    rows += [(150, hot, 0), (150, hot, 0), (50, hot[:5], 0), (2000, [], 1), (None, hot, 0), (2001, None, 1), (2002, hot, None), (2003, [float("nan")] * 12, 0), (2004, [None, 1.0], 0), (2005, [float("inf")], 0), (2050, [0.0] * 12, 3), (2100, hot, 77)]
    if kind == "large":
        rows = [(v, x and [c if c is None else c * 1e5 for c in x], l) for v, x, l in rows]
    return rows


@pytest.mark.parametrize("kind", ["plain", "large"])
def test_hard_negatives_equal_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(negatives, "SAMPLE", 4)
    rows = vectors(kind)
    df = spark.createDataFrame([(v, x, l, "e") for v, x, l in rows], "vec_id long, embedding array<double>, label int, LABEL string")
    use = negatives.usable(df.repartition(3)).selectExpr("*", "vec_id % 50 = 0 as anchor").cache()
    got = negatives.mine(use).collect()
    use.unpersist()
    assert Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got) == hard_by_hand(rows)


def test_hard_negatives_of_little(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(50, [1.0], 1)], [(50, [], 1), (1, [], 1), (2, [], 2)], [(1, [1.0], 1), (2, [1.0], 2)]):
        use = negatives.usable(spark.createDataFrame(rows, schema)).selectExpr("*", "vec_id % 50 = 0 as anchor")
        assert Counter(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in negatives.mine(use).collect()) == hard_by_hand(rows)


# ---- 13


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves, arity):
    """Root, and each leaf's siblings by level as (left, right)."""
    paths, spans, level = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(level) > 1:
        up, over = [], []
        for a in range(0, len(level), arity):
            run = level[a : a + arity]
            for j in range(len(run)):
                for leaf in spans[a + j]:
                    paths[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(h("".join(run)))
            over.append(list(itertools.chain(*spans[a : a + arity])))
        level, spans = up, over
    return level[0], paths


@pytest.mark.parametrize(("arity", "sources"), [(2, 1), (3, 9), (3, 28), (4, 3)])
def test_manifest_equals_brute_force(spark, arity, sources):
    rng = random.Random(arity + sources)
    names = [None, "", *[f"s{i}é" for i in range(sources)]]
    rows = [(rng.choice([None, *range(150)]), rng.choice(names) if i % 3 else "s0é", rng.choice(["t", "long " * 40, None, ""])) for i in range(220)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    leaf = merkle.leaf_of(F.col("doc_id"), F.col("source"), F.col("text"))
    got = merkle.manifest(df.select(F.col("doc_id").alias("id"), F.col("source").alias("g"), leaf.alias("leaf"), F.col("text").alias("kept")), arity, ("kept",))
    got = got.select("id", "g", merkle.text_of("leaf").alias("leaf"), merkle.text_of("top").alias("top"), merkle.text_of("root").alias("root"), merkle.proof_of(F.col("path")).alias("proof"), merkle.folded(F.col("path"), F.col("leaf")).alias("back"), "kept").collect()

    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    groups = defaultdict(list)
    for i, s, t in rows:
        groups[s].append((i is not None, i or 0, h(field(i) + field(s) + field(t))))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s])], arity) for s in order}
    root, above = tree([trees[s][0] for s in order], arity)
    want = Counter()
    for s, over in zip(order, above, strict=True):
        for (known, i, leaf), path in zip(sorted(groups[s]), trees[s][1], strict=True):
            want[i if known else None, s, leaf, trees[s][0], root, "".join(a + b for a, b in path + over), root] += 1
    assert Counter((r.id, r.g, r.leaf, r.top, r.root, r.proof, r.back) for r in got) == want
    assert all(r.leaf == h(field(r.id) + field(r.g) + field(r.kept)) for r in got)


def test_manifest_of_little(spark):
    schema = "id long, g string, leaf binary"
    assert merkle.manifest(spark.createDataFrame([], schema)).count() == 0
    one = merkle.manifest(spark.createDataFrame([(None, None, b"x" * 32)], schema)).first()
    assert bytes(one.root) == bytes(one.top) == bytes(one.leaf) == b"x" * 32 and one.path == []


def test_a_tampered_leaf_does_not_fold_to_the_root(spark):
    rows = spark.createDataFrame([(i, "s", hashlib.sha256(bytes([i])).digest()) for i in range(11)], "id long, g string, leaf binary")
    found = merkle.manifest(rows).select(merkle.folded(F.col("path"), F.lit(b"y" * 32)).alias("bad"), merkle.folded(F.col("path"), F.col("leaf")).alias("good"), merkle.text_of("root").alias("root")).collect()
    assert all(r.good == r.root != r.bad for r in found)


# ---- 7


def test_labels_are_bounded_and_awkward_ones_left_out(spark):
    from sentrylake.llm import toxicity

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(3000)] + [(None, "x"), (5, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, "z") for i in range(3000)] + [(None, 1, "z"), (4, None, "z"), (4, 7, "z"), (4, 1, "z"), (6, 1, "z")], "doc_id long, toxic int, TOXIC string")
    rows = toxicity.training_rows(docs, labels)
    kept = {r.text: r.toxic for r in rows.collect()}
    assert "x" not in kept and 1800 < len(kept) < 2200 and all(kept.get(f"text {i}", 1) == 1 for i in (4, 6))
    assert "Exchange hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()
    few = toxicity.training_rows(docs, labels, most=300).count()
    assert 200 < few < 400
    assert toxicity.training_rows(docs, labels.limit(0)).count() == 0
