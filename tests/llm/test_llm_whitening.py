"""Whitening against numpy and exact arithmetic."""
import itertools
import math
from fractions import Fraction

import numpy as np
import pytest

from topicflow.llm import whitening as W


def expand(roots):
    p = [1]
    for r in roots:
        p = [(p[k - 1] if k else 0) - (r * p[k] if k < len(p) else 0) for k in range(len(p) + 1)]
    return p


def minors_polynomial(a):
    """Coefficients by sums of principal minors."""
    d = len(a)

    def det(rows):
        if not rows:
            return 1
        return sum((-1) ** k * a[rows[0]][c] * minor(rows[1:], [x for x in cols if x != c]) for k, (c, cols) in
                   enumerate((c, rows) for c in rows))

    def minor(rows, cols):
        if not rows:
            return 1
        return sum((-1) ** k * a[rows[0]][c] * minor(rows[1:], cols[:k] + cols[k + 1:]) for k, c in enumerate(cols))
    return [(-1) ** (d - k) * sum(minor(list(s), list(s)) for s in itertools.combinations(range(d), d - k)) for k in range(d + 1)]


def test_limbs_are_exact():
    y = np.array([[0, 1, -1, (1 << 60), -(1 << 60), 123456789012345678, 524288, -524288, 524287]])
    parts = W.limbs(y)
    assert [sum(int(p[0, k]) << (W.LIMB * i) for i, p in enumerate(parts)) for k in range(y.shape[1])] == y[0].tolist()
    assert all(np.abs(p).max() <= 1 << (W.LIMB - 1) for p in parts)


def test_scatter_sums(spark):
    draw = np.random.default_rng(3)
    y = np.vstack([draw.integers(-500, 500, (300, 5)), draw.integers(-(1 << 59), 1 << 59, (20, 5))])
    n, sums, products = W.moments(spark.createDataFrame([(r,) for r in y.tolist()], "y array<bigint>").repartition(4), 5)
    z = y.astype(object)
    assert n == 320 and sums == z.sum(axis=0).tolist() and products == (z.T @ z).tolist()


def test_primes():
    ps = W.primes_beyond(1 << 200)
    assert ps[0] == 2147483647 and math.prod(ps) > 1 << 200 and math.prod(ps[:-1]) <= 1 << 200
    assert all(p % k for p in ps[:3] for k in range(2, 46341))


@pytest.mark.parametrize("d", [1, 2, 3, 5])
def test_polynomial_equals_minors(spark, d):
    b = np.random.default_rng(d).integers(-30, 30, (d, d + 1)).astype(object)
    a = (b @ b.T).tolist()
    assert W.characteristic_polynomial(spark, a) == minors_polynomial(a)


def test_polynomial_of_sparse_and_singular_matrices(spark):
    for a in ([[0, 0], [0, 0]], [[4, 0, 0], [0, 4, 0], [0, 0, 9]], [[1, 1, 1], [1, 1, 1], [1, 1, 1]], [[2, 0, 1], [0, 3, 0], [1, 0, 2]]):
        assert W.characteristic_polynomial(spark, a) == minors_polynomial(a)


def test_counts_of_roots():
    p = expand([0, 0, 3, 3, 7, 10])
    assert [W.above(p, a) for a in (-1, 0, 2, 3, 6, 7, 9, 10, 11)] == [6, 4, 4, 2, 2, 1, 1, 0, 0]


@pytest.mark.parametrize("roots, most, want", [([5], 8, [(5, 1)]), ([0, 0, 1, 2], 8, [(2, 1), (1, 1)]), ([4, 4, 4, 9], 8, [(9, 1), (4, 3)]),
                                              ([1, 2, 3, 4, 5, 6, 7, 8, 9, 10], 3, [(10, 1), (9, 1), (8, 1)]),
                                              ([10 ** 15, 10 ** 15 + 1, 10 ** 15 + 2, 1], 8, [(10 ** 15 + 2, 1), (10 ** 15 + 1, 1), (10 ** 15, 1), (1, 1)])])
def test_roots(roots, most, want):
    got = W.largest_roots(expand(roots), most)
    assert [(round(r / 2 ** W.FINE), m) for r, m in got] == want
    assert all(abs(Fraction(r, 1 << W.FINE) - w) <= Fraction(1, 1 << (W.FINE - 1)) for (r, _), (w, _) in zip(got, want))


def test_irrational_roots():
    p = [-1, 6, -5, 1]                     # of a matrix with irrational eigenvalues
    got = [r / 2 ** W.FINE for r, _ in W.largest_roots(p, 3)]
    assert np.allclose(got, sorted(np.roots(p[::-1]).real, reverse=True), rtol=1e-12)


def test_components_of_close_and_equal_roots():
    base = np.linalg.qr(np.random.default_rng(0).normal(size=(6, 6)))[0]
    a = np.rint(base @ np.diag([10 ** 9, 10 ** 9 - 10 ** 5, 5 * 10 ** 8, 10 ** 6, 10 ** 4, 10 ** 2]) @ base.T).astype(int)
    a = ((a + a.T) // 2).tolist()
    val, vec = np.linalg.eigh(np.array(a, float))
    for want, direction in zip(val[::-1][:3], vec.T[::-1]):
        got = W.null_vectors(a, int(Fraction(want) * (1 << W.FINE)), 1)[0]
        assert abs(abs(got @ direction) - 1) < 1e-9
    same = [[7, 0, 0], [0, 7, 0], [0, 0, 3]]
    two = np.array(W.null_vectors(same, 7 << W.FINE, 2))
    assert np.allclose(two @ two.T, np.eye(2), atol=1e-14) and np.allclose(two[:, 2], 0, atol=1e-14)


def reference(v, most=8):
    x = np.floor(1024 * np.asarray(v, float)) + 100000
    val, vec = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], -1))
    val, vec = val[::-1][:most], vec[:, ::-1][:, :most]
    xi = x.astype(int).astype(object)
    return (x - x.mean(axis=0)) @ vec / np.sqrt(val), val / np.cov(x.T, bias=True).reshape(x.shape[1], -1).trace(), \
        ((len(x) * xi - xi.sum(axis=0)) ** 2).sum(axis=1)


def check(rows, ids, v, most=8):
    w, explained, deviation = reference(v, most)
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(got) == len(rows) == w.size
    mine = np.array([[got[i, k + 1]["whitened"] for k in range(w.shape[1])] for i in ids])
    assert np.abs(mine * np.sign((mine * w).sum(axis=0)) - w).max() < 1e-8
    assert np.allclose([got[ids[0], k + 1]["explained"] for k in range(w.shape[1])], explained, rtol=1e-9)
    assert [int(got[i, 1]["deviation"]) for i in ids] == deviation.tolist()
    assert {r["n"] for r in rows} == {len(ids)} and max(r["identity_error"] for r in rows) < 1e-9


def test_given_table(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toPandas()
    check(W.op12_exact_whitening(spark, "/root/testdata/sf0.01").collect(), e.vec_id.tolist(), e.embedding.tolist())


def test_odd_rows_are_dropped(spark):
    draw = np.random.default_rng(1)
    v = draw.normal(size=(40, 3)).tolist()
    good = [(i, x, 1, "n", 0.5) for i, x in enumerate(v)]
    bad = [(100, None, 1, "n", 0.5), (101, [], 1, "n", 0.5), (102, [1.0, None, 2.0], 1, "n", 0.5), (103, [1.0, float("nan"), 2.0], 1, "n", 0.5),
           (104, [1.0, float("-inf"), 2.0], 1, "n", 0.5), (105, [1.0, 2.0], 1, "n", 0.5), (106, [1.0, 1e300, 0.0], 1, "n", 0.5)]
    frame = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>, n int, w string, whitened double")
    check(W.whiten(frame).collect(), [r[0] for r in good], v)


def test_large_entries_stay_exact(spark):
    v = [[1e11 + k, -3.0 * k * k, 2e14 / (k + 1)] for k in range(12)]
    rows = W.whiten(spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")).collect()
    deviation = {r["vec_id"]: r["deviation"] for r in rows}
    x = [[math.floor(1024 * Fraction(c)) for c in r] for r in v]
    s = [sum(c) for c in zip(*x)]
    exact = [sum((12 * c - t) ** 2 for c, t in zip(r, s)) for r in x]
    assert [deviation[k] for k in range(12)] == [e if e < 10 ** 38 else None for e in exact]


def test_equal_single_and_repeated_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    assert W.whiten(spark.createDataFrame([], kind)).count() == 0
    assert W.whiten(spark.createDataFrame([(1, [1.0, 2.0])], kind)).count() == 0
    assert W.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).count() == 0
    line = W.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [2.0, 4.0]), (3, [2.0, 4.0]), (3, [2.0, 4.0])], kind)).collect()
    assert len(line) == 4 and {r["component"] for r in line} == {1} and line[0]["explained"] == 1.0
