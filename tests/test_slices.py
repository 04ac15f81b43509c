"""Scores of dosage slices, and the path from dosage files to results, against the long form."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinspark.operators import blocks, prep, slices
from kinspark.operators.nullmodel import fit_joint, fit_single
from kinspark.operators.scoretest import RESULT, score
from kinspark.plans.scan import array_score, scan_files
from test_engine import N, SEEN, fixture
from test_files import write_bed


def arrays(spark, g, places, dosages="array<tinyint>"):
    order = spark.createDataFrame([(i, int(p)) for i, p in enumerate(places)], "iid long, position int")
    rows = []
    for m, row in enumerate(g):
        out = [0] * len(places)
        for i, p in enumerate(places):
            out[p] = None if row[i] is None else int(row[i])
        rows.append((f"v{m}", out))
    return spark.createDataFrame(rows, f"snp string, dosage {dosages}").coalesce(1), order


def four_models(people, grm):
    one = people.join(blocks.one_of_each(people.select("iid", F.col("family").alias("block_id"))), "iid", "left_semi")
    seen = people.filter("y_obs is not null")
    return {
        "joint": fit_joint(people, grm, ["x1", "x2"], floor=None), "observed": fit_single(seen, blocks.submatrix(grm, seen), ["x1"], "y_obs", floor=None),
        "apart": fit_joint(one, None, ["x1"], covariance="diag"), "plain": fit_single(seen, None, ["x1", "x2"], "y_obs", "ols"),
    }


def close(a, b):
    return a is b is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)


def test_four_models_by_slices(spark, monkeypatch):
    """Three buckets, three runs, missing dosages, a variant without carriers."""
    monkeypatch.setattr(slices, "RUN_VARIANTS", 2)
    people, grm, dosages, *_, g = fixture(spark)
    g = [[None if (i + m) % 17 == 0 else v for i, v in enumerate(row)] for m, row in enumerate(g)] + [[0] * N]
    models = four_models(people, grm)
    variants, order = arrays(spark, g, np.random.default_rng(5).permutation(N))
    long = spark.createDataFrame([(f"v{m}", i, float(v)) for m, row in enumerate(g) for i, v in enumerate(row) if v], "snp string, iid long, g double")
    for lanes in (1, 3):
        found = {r.snp: r for r in slices.score_slices(variants, order, models, lanes=lanes, buckets=3).collect()}
        assert len(found) == 6
        for name, model in models.items():
            want = {r.snp: r for r in score(long, model).collect()}
            for snp, r in found.items():
                for c in RESULT[1:]:
                    assert close(r[f"{name}_{c}"], want[snp][c] if snp in want else None)
    dealt = slices.placed_people(order, models, 3)
    assert dealt.select("bucket").distinct().count() == 3
    runs = slices.slices(variants, dealt, None, 2).collect()
    assert len({r.run for r in runs}) == 3 and len(runs) == 9
    # each dosage of the models' people is shuffled once, as a byte
    assert sum(len(r.payload) for r in runs) == 6 * dealt.count()


def test_blocks_must_agree(spark):
    people, grm, *_ = fixture(spark)
    order = spark.createDataFrame([(i, i) for i in range(N)], "iid long, position int")
    models = {"a": fit_single(people, grm, ["x1"], "y"), "b": fit_single(people.withColumn("family", F.col("iid") % 2), grm.filter("i % 2 = j % 2"), ["x1"], "y")}
    with pytest.raises(ValueError, match="blocks"):
        slices.score_slices(spark.createDataFrame([("v", [0] * N)], "snp string, dosage array<tinyint>"), order, models, buckets=40)
    with pytest.raises(ValueError, match="genotyped"):
        slices.placed_people(order.limit(3), models)


def test_repair(spark):
    people, *_, g = fixture(spark)
    seen = people.filter("y_obs is not null")
    g = [list(map(int, row)) for row in g]
    g[1][:SEEN], g[3][:SEEN] = [0] * SEEN, [2] * SEEN
    models = {"m": fit_single(seen, None, ["x1"], "y_obs", "ols")}
    variants, order = arrays(spark, g, range(N))
    long = spark.createDataFrame([(f"v{m}", i, float(v)) for m, row in enumerate(g) for i, v in enumerate(row) if v], "snp string, iid long, g double")
    constant = blocks.monomorphic(variants.select("snp"), long, seen, SEEN)
    want = {r.snp: r for r in score(blocks.repair_constant(long, constant, seen), models["m"]).collect()}
    found = slices.score_slices(variants, order, models, observed=seen.select("iid")).collect()
    assert {r.snp for r in found} == set(want) and all(close(r.m_t_score, want[r.snp].t_score) and r.m_t_score is not None for r in found)


def test_files_to_results(spark, tmp_path):
    people, grm, *_, g = fixture(spark)
    models = four_models(people, grm)
    write_bed(tmp_path / "study", [[int(v) for v in row] for row in g])
    (tmp_path / "study.fam").write_text("".join(f"f {i}_{i} 0 0 1 -9\n" for i in range(N)))
    (tmp_path / "study.bim").write_text("".join(f"1 v{m} 0 {m} A G\n" for m in range(5)))
    scan_files(spark, f"{tmp_path}/study", models, f"{tmp_path}/out", "protein_1", chunk=2)
    scan_files(spark, f"{tmp_path}/study", {"plain": models["plain"]}, f"{tmp_path}/out", "protein_2", only=spark.createDataFrame([("v1",), ("v4",)], "snp string"))
    found = spark.read.option("mergeSchema", "true").parquet(f"{tmp_path}/out")
    first = {r.snp: r for r in found.filter("protein = 'protein_1'").collect()}
    long = spark.createDataFrame([(f"v{m}", int(i), float(g[m, i])) for m, i in np.argwhere(g)], "snp string, iid long, g double")
    for name, model in models.items():
        for r in score(long, model).collect():
            assert all(close(first[r.snp][f"{name}_{c}"], r[c]) for c in RESULT[1:])
    assert {r.chunk for r in first.values()} == {0, 1, 2}
    assert {r.snp for r in found.filter("protein = 'protein_2'").collect()} == {"v1", "v4"}
    with pytest.raises(ValueError, match="unknown"):
        scan_files(spark, f"{tmp_path}/study", models, f"{tmp_path}/out", "p", only=spark.createDataFrame([("v9",)], "snp string"))


def test_scores_of_arrays(spark):
    *_, g = fixture(spark)
    variants, order = arrays(spark, [list(map(int, row)) for row in g], range(N))
    weights = spark.createDataFrame([("v0", 0.5), ("v3", -2.0)], "snp string, w double")
    long = spark.createDataFrame([(f"v{m}", int(i), float(v)) for m, row in enumerate(g) for i, v in enumerate(row)], "snp string, iid long, g double")
    want = {r.iid: r.prs for r in prep.weighted_score(long, weights, 1.5).collect()}
    found = {r.iid: r.prs for r in array_score(variants, order, weights, 1.5).collect()}
    assert found.keys() == want.keys() and all(close(found[i], want[i]) for i in want)
