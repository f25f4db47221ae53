"""Operators 11 and 12 against brute force, and on awkward tables."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from opinara.llm import hard_negatives, queries, vectors, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def embeddings(spark, sf=SF):
    return spark.read.parquet(f"{sf}/embeddings.parquet")


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def slow_mine(rows, every=50, positives=5, negatives=3, scale=256, low=50, high=95):
    """By the definition: rows of (id, vector, label)."""
    rows = [(i, [math.floor(scale * c) for c in v], label) for i, v, label in rows if i is not None and label is not None and usable(v)]
    out = []
    for a, (i, x, label) in enumerate(rows):
        if i % every:
            continue
        score = [sum(p * q for p, q in zip(x, y)) for _, y, _ in rows]
        order = sorted(range(len(rows)), key=lambda k: (-score[k], rows[k][0], k))
        for p in [k for k in order if k != a and rows[k][2] == label][:positives]:
            inside = [k for k in order if rows[k][2] != label and low * score[p] <= 100 * score[k] <= high * score[p]]
            out += [(i, rows[p][0], n + 1, rows[k][0], score[p], score[k]) for n, k in enumerate(inside[:negatives])]
    return sorted(out)


def told(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_hard_negatives_equal_brute_force(spark):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in embeddings(spark).collect()]
    got = told(queries.op11_hard_negatives(spark, SF))
    assert got == slow_mine(rows) and got


@pytest.mark.parametrize("blocks", [(7, 3), (64, 1000)])
def test_hard_negatives_with_ties_copies_and_many_blocks(spark, blocks):
    """Small integers make ties; a third of the rows are one vector; blocks are tiny."""
    rng = random.Random(3)
    rows = [(k, [rng.randint(-2, 2) / 4 for _ in range(5)], k % 4) for k in range(120)]
    rows += [(200 + k, [0.5, 0.25, 0.5, -0.25, 0.0], k % 3) for k in range(60)]
    rows += [(500, None, 1), (501, [0.1, None, 0.2, 0.3, 0.4], 1), (502, [float("nan")] * 5, 2), (503, [float("inf")] * 5, 2), (504, [0.5] * 5, None), (None, [0.5] * 5, 1)]
    got = told(hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, scale=8, rows_per_block=blocks[0], anchors_per_block=blocks[1]))
    assert got == slow_mine(rows, every=10, scale=8) and got


def test_hard_negatives_awkward_and_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.mine(none, F.col("vec_id") % 50 == 0).collect() == []
    # a repeated row is another row; clashing names do no harm; a vector of another length takes no part
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.8, 0.0], 2), (3, [0.7, 0.0], 2), (50, [1.0], 1), (4, [], 2)]
    d = spark.createDataFrame(rows, SCHEMA)
    for clash in ("id", "x", "v", "rid", "anchor", "codes", "left", "p", "q", "n"):
        d = d.withColumn(clash, F.lit("z"))
    got = told(hard_negatives.mine(d, F.col("vec_id") % 50 == 0))
    assert got == slow_mine(rows[:5])
    assert [r[:4] for r in got][:2] == [(0, 0, 1, 2), (0, 0, 1, 2)]
    with pytest.raises(OverflowError):
        vectors.dots(np.full((1, 4), 1 << 40), np.full(4, 1 << 40))


def test_intervals_hold_every_score():
    rng = np.random.default_rng(7)
    x = rng.integers(-300, 300, (500, 9))
    x[0] *= 10**6
    book = hard_negatives.Codebook(x[1:200], centres=16)
    codes, left = book.encode(x)
    low, high = hard_negatives.intervals(book, codes.astype(np.intp), left, x[:40])
    exact = x[:40] @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    # the filter does leave rows out
    assert np.median((high - low)[:, 1:]) < np.ptp(exact[1:, 1:])


def slow_whitening(vecs, components=16, scale=64, offset=1_000_000):
    x = [tuple(math.floor(scale * float(np.float32(c))) + offset for c in v) for v in vecs]
    fit = np.array(sorted(set(x)), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    y = fit * n - sums
    cov = np.array([[float(Fraction(int(c), n**3)) for c in row] for row in (y.T @ y)])
    values, turn = np.linalg.eigh(cov)
    values, turn = values[::-1][:components], turn[:, ::-1][:, :components]
    centred = np.array(x, dtype=object) * n - sums
    z = (centred / n).astype(float) @ turn / np.sqrt(values)
    return n, (centred**2).sum(axis=1), z, values / np.trace(cov)


def test_whitening_equals_eigh(spark):
    rows = embeddings(spark).orderBy("vec_id").collect()
    n, deviation, z, share = slow_whitening([r.embedding for r in rows])
    got = queries.op12_whitening(spark, SF).orderBy("vec_id", "component").toPandas()
    assert len(got) == len(rows) * 16 and set(got["n"]) == {n} and got["identity_error"].max() < 1e-9 and got["identity_error"].nunique() == 1
    assert got["deviation"].to_numpy().reshape(-1, 16)[:, 0].tolist() == [int(x) for x in deviation]
    assert np.allclose(got["explained"].to_numpy()[:16], share, rtol=1e-9)
    own = got["whitened"].to_numpy().reshape(-1, 16)
    sign = np.sign((own * z).sum(axis=0))
    assert np.allclose(own, z * sign, atol=1e-8)


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(2)
    for d, r in ((1, 1), (2, 1), (9, 9), (16, 40), (31, 5)):
        a = rng.normal(size=(r, d))
        c = a.T @ a
        values, turn = whitening.jacobi(c)
        assert np.allclose(turn.T @ turn, np.eye(d), atol=1e-13) and np.allclose(turn * values @ turn.T, c, atol=1e-12 * np.trace(c))
        assert (np.diff(values) <= 0).all()
    # a graded matrix: each eigenvalue is right to its own last digits
    scale = np.logspace(0, -9, 8)
    core = np.eye(8) + 0.1 * np.ones((8, 8))
    values, _ = whitening.jacobi(core * np.outer(scale, scale))
    exact = [float(v) for v in sorted(_graded(core, scale), reverse=True)]
    assert np.allclose(values, exact, rtol=1e-10)
    assert whitening.jacobi(np.zeros((0, 0)))[0].tolist() == [] and whitening.jacobi(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


def _graded(core, scale):
    """Eigenvalues of diag(scale) core diag(scale) as squared singular values of a triangular factor, by one-sided rotations."""
    g = np.linalg.cholesky(core).T * scale
    for _ in range(60):
        for i in range(len(g)):
            for j in range(i + 1, len(g)):
                p, q, r = g[:, i] @ g[:, i], g[:, j] @ g[:, j], g[:, i] @ g[:, j]
                if abs(r) > 1e-16 * math.sqrt(p * q):
                    tau = (q - p) / (2 * r)
                    t = math.copysign(1, tau) / (abs(tau) + math.hypot(1, tau))
                    c = 1 / math.hypot(1, t)
                    g[:, i], g[:, j] = c * g[:, i] - c * t * g[:, j], c * t * g[:, i] + c * g[:, j]
    return (g**2).sum(axis=0)


def test_whitening_awkward_and_empty(spark):
    assert whitening.whitened(spark.createDataFrame([], SCHEMA)).collect() == []
    one = [(k, [0.5, 0.25], 1) for k in range(4)]
    assert whitening.whitened(spark.createDataFrame(one, SCHEMA)).collect() == []
    # copies count once; a dimension that never varies has no component; ids may be null or repeat
    rows = [(1, [0.0, 1.0, 2.0], 1)] * 5 + [(None, [1.0, 1.0, 0.5], None), (3, [0.5, 1.0, -1.0], 2)]
    rows += [(4, None, 1), (5, [0.1, None, 1.0], 1), (6, [float("nan")] * 3, 1), (7, [float("-inf")] * 3, 1), (8, [1.0], 1), (9, [], 1)]
    d = spark.createDataFrame(rows, SCHEMA)
    for clash in ("id", "x", "v", "n", "component", "deviation", "copies"):
        d = d.withColumn(clash, F.lit("z"))
    got = whitening.whitened(d).collect()
    assert {r.vec_id for r in got} == {1, None, 3} and len(got) == 14 and {r.n for r in got} == {3} and {r.component for r in got} == {1, 2}
    assert abs(sum(r.explained for r in got if r.vec_id == 3) - 1) < 1e-12 and got[0].identity_error < 1e-12
    x = [[1000000, 1000064, 1000128], [1000064, 1000064, 1000032], [1000032, 1000064, 999936]]
    sums = [sum(c) for c in zip(*x)]
    assert {r.deviation for r in got if r.vec_id == 3} == {sum((3 * a - s) ** 2 for a, s in zip(x[2], sums))}


def test_whitening_is_exact_for_wide_numbers(spark):
    """Products beyond 64 bits take Python integers: the share of each component stays right."""
    rng = np.random.default_rng(4)
    rows = [(k, [float(rng.integers(-(1 << 33), 1 << 33)), float(rng.integers(-5, 5))], 1) for k in range(40)]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    n, _, _, share = slow_whitening([[1.0 * c for c in r[1]] for r in rows], components=1)
    with pytest.raises(Exception, match="64 bits"):
        whitening.whitened(d).collect()
    model = whitening.fit(whitening.integers(d))
    assert model.n == n and abs(model.values[0] / model.trace - share[0]) < 1e-9
