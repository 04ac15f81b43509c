"""Null models and scores against dense linear algebra; native tails and quantiles against the standard library."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinspark.functions.normal import neg_log10_p, quantile
from kinspark.operators import blocks, nullmodel, scoretest
from kinspark.operators.eachvariant import score_each
from kinspark.operators.nullmodel import fit_joint, fit_single
from kinspark.operators.scoretest import score, score_arrays

N, SEEN = 36, 16
FAMILIES = np.array([0, 0, 1, 1, 1, 2, 2, 3, 3, 4, 4, 4, 5, 5, 6, 7] + [8 + k // 2 for k in range(20)])


def fixture(spark):
    rng = np.random.default_rng(1)
    same = FAMILIES[:, None] == FAMILIES[None, :]
    k = np.where(same, 0.4, 0.0) + 0.6 * np.eye(N)
    x = np.column_stack([np.ones(N), rng.normal(size=N), rng.normal(size=N)])
    shared = rng.normal(size=FAMILIES.max() + 1)[FAMILIES]
    y = 1.5 * shared + x[:, 1] + rng.normal(size=N)
    s = 0.6 * y + 0.5 * shared + rng.normal(size=N) * 0.5
    g = rng.integers(0, 3, size=(5, N)).astype(float)
    rows = [(i, int(FAMILIES[i]), float(x[i, 1]), float(x[i, 2]), float(s[i]), float(y[i]), float(y[i]) if i < SEEN else None) for i in range(N)]
    people = spark.createDataFrame(rows, "iid long, family long, x1 double, x2 double, s double, y double, y_obs double")
    grm = spark.createDataFrame([(int(i), int(j), float(k[i, j])) for i, j in np.argwhere(k)], "i long, j long, k double")
    dosages = spark.createDataFrame([(f"v{m}", int(i), float(g[m, i])) for m, i in np.argwhere(g)], "snp string, iid long, g double")
    return people, grm, dosages, k, x, s, y, g


def resid(x, y):
    return y - x @ np.linalg.lstsq(x, y, rcond=None)[0]


def moments(k, a, b):
    off = k - np.diag(np.diag(k))
    tau = a @ off @ b / (off**2).sum()
    return tau, (a @ b - tau * np.trace(k)) / len(a)


def test_single(spark):
    people, grm, dosages, k, x, _, y, g = fixture(spark)
    found = {r.snp: r for r in score(dosages, fit_single(people, grm, ["x1", "x2"], "y")).collect()}
    e = resid(x, y)
    tau, sigma = moments(k, e, e)
    q = np.linalg.inv(tau * k + sigma * np.eye(N))
    p = q - q @ x @ np.linalg.inv(x.T @ q @ x) @ x.T @ q
    for m in range(5):
        u, v = g[m] @ p @ y, g[m] @ p @ g[m]
        r = found[f"v{m}"]
        assert np.allclose([r.t_score, r.beta, r.var_beta], [u * u / v, u / v, 1 / v])
        assert math.isclose(r.neg_log10_p, -math.log10(math.erfc(math.sqrt(u * u / v / 2))), abs_tol=1e-9)


def dense_joint(k, x, s, y, g, t, own, ts):
    """t_score, beta, var_beta by full matrices; t, own, ts: (tau, sigma) of target, surrogate and between them."""
    o, eye = np.arange(SEEN), np.eye(N)
    xo, go = x[o], g[o]
    s11, s12, q2 = (t[0] * k + t[1] * eye)[np.ix_(o, o)], (ts[0] * k + ts[1] * eye)[o], np.linalg.inv(own[0] * k + own[1] * eye)
    d = s12 @ q2
    v = np.linalg.inv(s11 - d @ s12.T)
    z = np.column_stack([g, x])
    zz = np.linalg.inv(z.T @ q2 @ z)
    part = y[o] - d @ s + d @ z @ zz @ z.T @ q2 @ s
    b = np.linalg.inv(xo.T @ v @ xo) @ xo.T @ v
    num = go @ v @ (part - xo @ (b @ part))
    v1 = go @ (v - v @ xo @ b)
    v2 = -v1 @ d @ s12.T + v1 @ d @ z @ zz @ z.T @ d.T
    var, info = v1 @ s11 @ v1 + v2 @ v1, v1 @ go
    return num**2 / var, num / info, var / info**2


def test_joint(spark):
    people, grm, dosages, k, x, s, y, g = fixture(spark)
    model = fit_joint(people, grm, ["x1", "x2"], floor=None)
    found = {r.snp: r for r in score(dosages, model).collect()}
    o = np.arange(SEEN)
    e_t, e_s = resid(x[o], y[o]), resid(x, s)
    pairs = moments(k[np.ix_(o, o)], e_t, e_t), moments(k, e_s, e_s), moments(k[np.ix_(o, o)], e_s[o], e_t)
    order = spark.createDataFrame([(i, N - 1 - i) for i in range(N)], "iid long, position int")
    arrays = spark.createDataFrame([(f"v{m}", [int(v) for v in g[m][::-1]]) for m in range(5)], "snp string, dosage array<tinyint>")
    by_array = {r.snp: r for r in score_arrays(arrays, order, model).collect()}
    apart = {r.snp: r for r in score_arrays(arrays, order, model, most_bytes=0).collect()}
    for m in range(5):
        want = dense_joint(k, x, s, y, g[m], *pairs)
        for result in (found, by_array, apart):
            r = result[f"v{m}"]
            assert np.allclose([r.t_score, r.beta, r.var_beta], want)


def test_full_observation_and_batches(spark, monkeypatch):
    people, grm, dosages, *_ = fixture(spark)
    model = fit_single(people, grm, ["x1"], "y")
    whole = {r.snp: r.t_score for r in score(dosages, model).collect()}
    alone = score(dosages.filter("snp = 'v3'"), model).collect()
    assert len(alone) == 1 and math.isclose(alone[0].t_score, whole["v3"])
    monkeypatch.setattr(nullmodel, "BUCKET_PEOPLE", 5)
    monkeypatch.setattr(scoretest, "TILE_VARIANTS", 2)
    tiled = {r.snp: r.t_score for r in score(dosages, fit_single(people, grm, ["x1"], "y", block=None)).collect()}
    assert tiled.keys() == whole.keys() and np.allclose([tiled[v] for v in whole], list(whole.values()))


def test_independent_joint_equals_diagonal_matrix(spark):
    people, _, dosages, k, x, s, y, g = fixture(spark)
    one = people.join(blocks.one_of_each(people.select("iid", F.col("family").alias("block_id"))), "iid", "left_semi")
    ids = sorted(r.iid for r in one.collect())
    seen = [i for i in ids if i < SEEN]
    x, n_o = x[:, :2], len(seen)
    e_t, e_s = resid(x[seen], y[seen]), resid(x[ids], s[ids])
    st, ss, sx = e_t @ e_t / (n_o - 1), e_s @ e_s / (len(ids) - 1), e_s[:n_o] @ e_t / (n_o - 1)
    found = {r.snp: r for r in score(dosages, fit_joint(one, None, ["x1"], covariance="diag")).collect()}
    v = 1 / (st - sx * sx / ss)
    for m in range(5):
        z, zo, go = np.column_stack([g[m], x])[ids], x[seen], g[m][seen]
        fitted = z @ np.linalg.lstsq(z, s[ids], rcond=None)[0]
        part = y[seen] - sx / ss * (s[seen] - fitted[:n_o])
        gone = go - zo @ np.linalg.lstsq(zo, go, rcond=None)[0]
        hat = z @ np.linalg.inv(z.T @ z) @ z.T
        num, info = v * gone @ part, v * gone @ go
        var = v * v * (st * gone @ gone + sx * sx / ss * (gone @ hat[:n_o, :n_o] @ gone - gone @ gone))
        r = found[f"v{m}"]
        assert np.allclose([r.t_score, r.beta, r.var_beta], [num**2 / var, num / info, var / info**2])


@pytest.mark.parametrize("n_covariates", [8, 30])
def test_many_covariates(spark, n_covariates):
    """Plans hold for as many covariates as a cohort has; the results are those of dense algebra."""
    rng = np.random.default_rng(4)
    n, families = 240, np.arange(240) // 3
    x = np.column_stack([np.ones(n), rng.normal(5, 2, size=(n, n_covariates))])
    y = rng.normal(size=80)[families] + x[:, 1] + rng.normal(size=n)
    g = rng.integers(0, 3, size=(4, n)).astype(float)
    k = np.where(families[:, None] == families[None, :], 0.5, 0.0) + 0.5 * np.eye(n)
    names = [f"c{j}" for j in range(n_covariates)]
    people = spark.createDataFrame([(i, int(families[i]), float(y[i]), *map(float, x[i, 1:])) for i in range(n)], "iid long, family long, y double, " + ", ".join(f"{c} double" for c in names))
    grm = spark.createDataFrame([(int(i), int(j), float(k[i, j])) for i, j in np.argwhere(k)], "i long, j long, k double")
    dosages = spark.createDataFrame([(int(m), int(i), float(g[m, i])) for m, i in np.argwhere(g)], "snp int, iid long, g double")
    found = {r.snp: r for r in score(dosages, fit_single(people, grm, names, "y")).collect()}
    e = resid(x, y)
    tau, sigma = moments(k, e, e)
    q = np.linalg.inv(tau * k + sigma * np.eye(n))
    p = q - q @ x @ np.linalg.inv(x.T @ q @ x) @ x.T @ q
    for m in range(4):
        u, v = g[m] @ p @ y, g[m] @ p @ g[m]
        assert np.allclose([found[m].t_score, found[m].beta, found[m].var_beta], [u * u / v, u / v, 1 / v])


def test_models_refuse_what_they_cannot_take(spark):
    people, grm, *_ = fixture(spark)
    with pytest.raises(ValueError, match="miss"):
        fit_single(people, grm, ["x1"], "y_obs")
    with pytest.raises(ValueError, match="distinct"):
        fit_single(people.unionByName(people.limit(1)), grm, ["x1"], "y")
    crossing = grm.unionByName(spark.createDataFrame([(0, 30, 0.1), (30, 0, 0.1)], "i long, j long, k double"))
    with pytest.raises(Exception, match="between blocks"):
        fit_single(people, crossing, ["x1"], "y")


def test_tails_and_quantiles(spark):
    t = [0.0, 1e-12, 0.2, 0.45, 0.46, 3.84, 20.0, 31.9, 32.1, 100.0, 700.0, 1400.0]
    frame = spark.createDataFrame([(v,) for v in t], "t double")
    for v, p in frame.selectExpr("t", f"{neg_log10_p('t')} AS p").collect():
        assert math.isclose(p, -math.log10(math.erfc(math.sqrt(v / 2))) + 0.0, rel_tol=1e-9, abs_tol=1e-9), v
    assert 10_000 < frame.limit(1).selectExpr("t + 50000e0 AS t").selectExpr(neg_log10_p("t")).first()[0] < 11_000
    ps = [1e-300, 1e-12, 0.01, 0.074, 0.076, 0.5, 0.9, 0.999999]
    for v, z in spark.createDataFrame([(v,) for v in ps], "p double").selectExpr("p", quantile("p")).collect():
        assert math.isclose(z, NormalDist().inv_cdf(v), rel_tol=1e-12, abs_tol=1e-12)
    assert spark.sql(f"SELECT {quantile('p')} FROM (SELECT 1e0 AS p)").first()[0] is None


def test_blocks_of_any_shape(spark):
    rng = np.random.default_rng(7)
    n = 400
    edges = [(int(a), int(min(n - 1, a + rng.integers(1, 9)))) for a in rng.choice(n, 60, replace=False)]
    ids = spark.range(n).toDF("iid")
    grm = blocks.canonical(spark.createDataFrame([(a, b, 0.5) for a, b in edges], "i long, j long, k double"))
    old = blocks.SPAN
    blocks.SPAN = 37
    try:
        found = {r.iid: r.block_id for r in blocks.blocks(ids, grm).collect()}
    finally:
        blocks.SPAN = old
    reach, start, wanted = -1, 0, {}
    top = {i: max([i, *[max(e) for e in edges if i in e]]) for i in range(n)}
    for i in range(n):
        if reach < i:
            start = i
        wanted[i], reach = start, max(reach, top[i])
    assert found == wanted
    split = blocks.split_by_blocks(ids.select("iid", F.lit(0).alias("x")).join(spark.createDataFrame(list(found.items()), "iid long, block_id long"), "iid").select("iid", "block_id"))
    side = {r.iid: r.split for r in split.collect()}
    assert len(side) == n and all(side[i] == side[found[i]] for i in range(n))
    assert abs(sum(v == "train" for v in side.values()) - 320) <= max(list(found.values()).count(b) for b in set(found.values()))


def test_each_variant(spark):
    """The variant takes part in the surrogate's regression; all variances and inverses are its own."""
    people, grm, dosages, k, x, s, y, g = fixture(spark)
    found = {r.snp: r for r in score_each(dosages, people, grm, ["x1", "x2"]).collect()}
    o = np.arange(SEEN)
    for m in range(5):
        e_t, e_s = resid(x[o], y[o]), resid(np.column_stack([x, g[m]]), s)
        want = dense_joint(k, x, s, y, g[m], moments(k[np.ix_(o, o)], e_t, e_t), moments(k, e_s, e_s), moments(k[np.ix_(o, o)], e_s[o], e_t))
        r = found[f"v{m}"]
        assert np.allclose([r.t_score, r.beta, r.var_beta], want)


def test_adaptive_blocks_feed_the_model(spark):
    """Weak entries join families at the first threshold; the found blocks and the entries inside them fit."""
    people, grm, dosages, *_ = fixture(spark)
    weak = [(i, j, 0.0065) for a, b in ((1, 2), (4, 5), (6, 7)) for i, j in ((a, b), (b, a))]
    joined = grm.unionByName(spark.createDataFrame(weak, "i long, j long, k double"))
    found, threshold = blocks.adaptive_blocks(people.select("iid"), joined, most=3)
    assert threshold == 0.007 and blocks.block_sizes(found).first()["largest"] == 3
    kept, dropped = blocks.inside(joined, found)
    assert dropped == len(weak)
    placed = people.join(found, "iid")
    with pytest.raises(Exception, match="between blocks"):
        fit_single(placed, joined, ["x1", "x2"], "y", "grm", 0.01, block="block_id").members.count()
    one = score(dosages, fit_single(placed, kept, ["x1", "x2"], "y", "grm", 0.01, block="block_id")).orderBy("snp").collect()
    two = score(dosages, fit_single(people, grm, ["x1", "x2"], "y", "grm", 0.01, block="family")).orderBy("snp").collect()
    assert np.allclose([r.t_score for r in one], [r.t_score for r in two])
