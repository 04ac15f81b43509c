"""Many responses and many columns at once against one at a time; thresholds of blocks against one after another."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinspark.operators import blocks, prep, tables
from kinspark.operators.many import fit_many, score_many
from kinspark.operators.nullmodel import fit_single
from kinspark.operators.scoretest import RESULT, score
from kinspark.operators.slices import score_slices
from test_engine import N, fixture
from test_slices import arrays, close


@pytest.mark.parametrize("covariance", ["grm", "diag"])
def test_many_responses(spark, covariance):
    people, grm, dosages, *_, g = fixture(spark)
    people = people.withColumn("z", F.col("y") * 0.5 + F.col("x2") * F.col("x2"))
    matrix, names = (grm if covariance == "grm" else None), ["y", "s", "z"]
    model = fit_many(people, matrix, ["x1", "x2"], names, covariance, 0.01)
    found = {(r.phenotype, r.snp): r for r in score_many(dosages, model).collect()}
    variants, order = arrays(spark, [list(map(int, row)) for row in g], range(N))
    sliced = {r.snp: r for r in score_slices(variants, order, {"m": model, "one": fit_single(people, matrix, ["x1"], "y", covariance)}, buckets=3).collect()}
    for name in names:
        for r in score(dosages, fit_single(people, matrix, ["x1", "x2"], name, covariance, 0.01)).collect():
            for c in RESULT[1:]:
                assert close(found[name, r.snp][c], r[c]) and close(sliced[r.snp][f"m_{name}_{c}"], r[c])
    assert len(found) == 15 and "one_t_score" in next(iter(sliced.values())).asDict()


def test_many_responses_are_checked(spark):
    people, grm, *_ = fixture(spark)
    with pytest.raises(ValueError, match="miss"):
        fit_many(people, grm, ["x1"], ["y", "y_obs"])
    with pytest.raises(ValueError, match="names"):
        fit_many(people, grm, ["x1"], ["y", "y"])


def test_thresholds(spark):
    rng = np.random.default_rng(8)
    ids = spark.range(200).withColumnRenamed("id", "iid")
    rows = [(i, i, 1.0) for i in range(200)] + [(i, j, float(k)) for i, j, k in zip(rng.integers(0, 195, 150), rng.integers(0, 5, 150), rng.random(150) * 0.08) for i, j in [(int(i), int(i + j))]]
    grm = blocks.canonical(spark.createDataFrame(rows, "i long, j long, k double"))
    at = [0.006, 0.02, 0.05, 0.5, 2.0]
    found = {r.level: r.largest for r in blocks.largest_blocks(ids, grm, at).collect()}
    for level, t in enumerate(at):
        assert found[level] == blocks.block_sizes(blocks.blocks(ids, grm, t)).first()["largest"]
    every = [round(0.006 + k * 0.001, 9) for k in range(90)]
    by_level = {r.level: r.largest for r in blocks.largest_blocks(ids, grm, every).collect()}
    for most in (3, 6):
        own, threshold = blocks.adaptive_blocks(ids, grm, most)
        assert threshold == next(t for level, t in enumerate(every) if by_level[level] <= most)
        assert blocks.block_sizes(own).first()["largest"] <= most
    assert blocks.adaptive_blocks(ids, grm, 200)[1] == 0.006 and blocks.adaptive_blocks(ids, grm, 1)[1] > 0.08
    with pytest.raises(ValueError, match="not numbers"):
        blocks.adaptive_blocks(ids, grm.union(spark.createDataFrame([(1, 2, math.nan)], "i long, j long, k double")))


def test_rank_sums(spark):
    rng = np.random.default_rng(9)
    rows = [(float(v), int(a), int(a) + 1, 5, None if k == 3 else int(a)) for k, (v, a) in enumerate(zip(rng.integers(0, 20, 80), rng.integers(0, 2, 80)))]
    df = spark.createDataFrame([*rows, (None, 1, 2, 5, 1), (math.nan, 0, 1, 5, 0)], "v double, a int, b int, c int, d int")
    one = prep.rank_sum(df.filter("NOT isnan(v)"), "a", "v").first()
    found = {r.column: r for r in prep.rank_sums(df, ["a", "b", "c"], "v").collect()}
    for c in ("a", "b"):
        assert (found[c].n1, found[c].n0, found[c].w) == (one.n1, one.n0, one.w) and math.isclose(found[c].neg_log10_p, one.neg_log10_p)
    assert tuple(found["c"]) == ("c", None, None, None, 0.0)
    with pytest.raises(Exception, match="missing entries in d"):
        prep.rank_sums(df, ["a", "d"], "v").collect()


def test_wide_correlations(spark):
    rng = np.random.default_rng(10)
    x, y = rng.normal(size=(60, 4)) + 1e6, rng.normal(size=60)
    x[:, 1] = 3.0
    rows = [([None if (k, c) == (7, 2) else float(v) for c, v in enumerate(r)], float(t)) for k, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "x array<double>, y double").repartition(5)
    found = {r.feature: r["corr"] for r in prep.wide_correlations(df, list("abcd"), "x", "y").collect()}
    assert found["b"] is None and found["c"] is None
    assert math.isclose(found["a"], np.corrcoef(x[:, 0], y)[0, 1], rel_tol=1e-8) and math.isclose(found["d"], np.corrcoef(x[:, 3], y)[0, 1], rel_tol=1e-8)
    assert {r["corr"] for r in prep.wide_correlations(df.withColumn("y", F.lit(None).cast("double")), list("abcd"), "x", "y").collect()} == {None}
    assert {r["corr"] for r in prep.wide_correlations(df.limit(0), list("abcd"), "x", "y").collect()} == {None}
    with pytest.raises(Exception, match="entries"):
        prep.wide_correlations(df, list("abc"), "x", "y").collect()


def test_train_sample_takes_the_floor(spark):
    people = spark.range(37).selectExpr("id AS iid", "1.0 AS y_obs")
    assert tables.train_sample(people, "y_obs").filter("split = 'train'").count() == 3


@pytest.mark.parametrize("sizes", [[1] * 7, [2] * 40 + [1], [50, 3, 3, 2, 9, 14, 14, 7], [1000, 1], [5]])
def test_best_split(spark, sizes):
    rows = [(1000 * k + i, 1000 * k) for k, size in enumerate(sizes) for i in range(size)]
    found = blocks.best_split(spark.createDataFrame(rows, "iid long, block_id long")).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r.iid // 1000, set()).add(r.split)
    assert all(len(v) == 1 for v in by.values())
    target, got = round(0.8 * len(rows)), sum(r.split == "train" for r in found)
    counts = {c: sizes.count(c) for c in set(sizes)}
    base = {c: math.floor(0.8 * n) for c, n in counts.items()}
    start = sum(c * n for c, n in base.items())
    every = []
    for seed in range(64):
        total, order = start, sorted(counts, key=lambda c: -c if seed == 0 else (c * 7919 + seed * 104729) % 10007)
        for c in [c for c in order for _ in range(counts[c] - base[c])]:
            if abs(total - target) <= 1:
                break
            if abs(total + c - target) <= abs(total - target):
                total += c
        every.append(total)
    assert abs(got - target) == min(abs(e - target) for e in every)
    assert got == max(e for e in every if abs(e - target) == abs(got - target))


def test_best_split_of_nothing(spark):
    assert blocks.best_split(spark.createDataFrame([], "iid long, block_id long")).collect() == []
