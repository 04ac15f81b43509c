"""Blocks too large for dense matrices against the dense path and against dense algebra."""

import tracemalloc

import numpy as np
import pytest

from kinspark.operators import families as fam
from kinspark.operators import nullmodel
from kinspark.operators.nullmodel import fit_joint, fit_single
from kinspark.operators.scoretest import score, score_arrays
from kinspark.operators.slices import score_slices


def chain(spark, n=400, cut=240):
    """A block of `cut` people who are related to their next two, and pairs."""
    rng = np.random.default_rng(7)
    k = np.eye(n)
    for i in range(n):
        for step, value in ((1, 0.3), (2, 0.15)):
            j = i + step
            if j < cut or (i >= cut and step == 1 and (i - cut) % 2 == 0 and j < n):
                k[i, j] = k[j, i] = value
    family = np.where(np.arange(n) < cut, 0, 1 + (np.arange(n) - cut) // 2)
    x = rng.normal(size=n)
    y = np.linalg.cholesky(k) @ rng.normal(size=n) + 0.5 * x + 0.5 * rng.normal(size=n)
    s = 0.5 * y + 0.9 * rng.normal(size=n)
    seen = rng.random(n) < 0.75
    g = rng.integers(0, 3, size=(6, n))
    g[4] = 0
    g[4, 3] = 1
    rows = [(i, int(family[i]), float(x[i]), float(s[i]), float(y[i]), float(y[i]) if seen[i] else None) for i in range(n)]
    people = spark.createDataFrame(rows, "iid long, family long, x1 double, s double, y double, y_obs double")
    grm = spark.createDataFrame([(int(i), int(j), float(k[i, j])) for i, j in np.argwhere(k)], "i long, j long, k double")
    dosages = spark.createDataFrame([(f"v{m}", int(i), float(g[m, i])) for m, i in np.argwhere(g)], "snp string, iid long, g double")
    order = spark.createDataFrame([(i, i) for i in range(n)], "iid long, position int")
    arrays = spark.createDataFrame([(f"v{m}", [int(v) for v in g[m]]) for m in range(6)], "snp string, dosage array<tinyint>")
    return people, grm, dosages, order, arrays


def numbers(rows):
    return np.array([[r.t_score, r.beta, r.var_beta, r.neg_log10_p] for r in sorted(rows, key=lambda r: r.snp)])


@pytest.mark.parametrize("kind", ["single", "joint"])
def test_sparse_blocks_equal_dense_ones(spark, monkeypatch, kind):
    people, grm, dosages, order, arrays = chain(spark)
    fit = (lambda: fit_single(people, grm, ["x1"], "y")) if kind == "single" else (lambda: fit_joint(people, grm, ["x1"]))
    dense = fit()
    want = numbers(score(dosages, dense).collect())
    monkeypatch.setattr(nullmodel, "MOST_IN_BLOCK", 10)
    sparse = fit()
    assert np.allclose(list(sparse.components.values()), list(dense.components.values()), rtol=1e-9)
    assert np.allclose(numbers(score(dosages, sparse).collect()), want, rtol=1e-8)
    assert np.allclose(numbers(score_arrays(arrays, order, sparse).collect()), want, rtol=1e-8)
    cut = score_slices(arrays, order, {"m": sparse}).collect()
    found = np.array([[r.m_t_score, r.m_beta, r.m_var_beta, r.m_neg_log10_p] for r in sorted(cut, key=lambda r: r.snp)])
    assert np.allclose(found, want, rtol=1e-8)


def test_five_thousand_people_within_a_gigabyte():
    n, rng = 5000, np.random.default_rng(2)
    i = np.repeat(np.arange(n), 7)
    j = i + np.tile(np.arange(-3, 4), n)
    good = (j >= 0) & (j < n)
    i, j = i[good], j[good]
    k = np.where(i == j, 1.0, 0.12)
    z = np.column_stack([np.ones(n), rng.normal(size=(n, 3))])
    seen = rng.random(n) < 0.5
    z[~seen, 3] = 0
    v = fam.Variances((0.5, 0.6), (0.7, 0.9), (0.3, 0.2))
    g = rng.integers(0, 3, size=(70, n)).astype(float)
    tracemalloc.start()
    blocks = fam.stacks(np.arange(n), np.zeros(n, np.int64), (i, j, k), 1000)
    w, rows = fam.weights(blocks, z, seen, v, 2)
    flat = fam.flat_rows(blocks, rows, n)
    ((large, known, variances),) = fam.large_from_flat(np.zeros(n, np.int64), flat, True)
    squares = large.quadratics(g, known, variances)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 30 and not fam.from_flat(np.zeros(n, np.int64), flat, 3)
    dense = np.zeros((n, n))
    dense[i, j] = k
    eye = np.eye(n)
    # without an inverse: the solutions are put back into the equations
    own = v.s[0] * dense + v.s[1] * eye
    assert np.allclose(own @ w[:, :3], np.column_stack([z[:, 2], z[:, :2]]), atol=1e-9)
    q = np.linalg.solve(own, g[:4].T)
    assert np.allclose(squares[:4, 0], (g[:4].T * q).sum(axis=0))
    cross = (v.ts[0] * dense + v.ts[1] * eye)[seen]
    middle = (v.t[0] * dense + v.t[1] * eye)[np.ix_(seen, seen)] - cross @ np.linalg.solve(own, cross.T)
    vg = np.linalg.solve(middle, g[:4, seen].T)
    assert np.allclose(squares[:4, 1], (g[:4, seen].T * vg).sum(axis=0))
    assert np.allclose(squares[:4, 2], (vg * (cross @ q)).sum(axis=0))


def test_sparse_covariance_must_be_positive_definite():
    pair = fam.Sparse(np.arange(2), np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1]), np.array([1.0, 3.0, 3.0, 1.0]))
    with pytest.raises(np.linalg.LinAlgError):
        pair.solved(fam.Variances((1.0, 0.1)), np.ones(2), np.array([[1.0], [-1.0]]))


def test_rows_without_entries_and_empty_sides():
    block = fam.Sparse(np.arange(3), np.array([0]), np.array([0]), np.array([2.0]))
    assert block.times(np.ones((3, 1))).ravel().tolist() == [2.0, 0.0, 0.0]
    assert np.allclose(block.solved(fam.Variances((1.0, 1.0)), np.ones(3), np.eye(3))[0], np.diag([1 / 3, 1, 1]))
    assert not block.solved(fam.Variances((1.0, 1.0)), np.ones(3), np.zeros((3, 2)))[0].any()
    assert block.quadratics(np.zeros((0, 3)), np.ones(3), fam.Variances((1.0, 1.0))).shape == (0, 1)
