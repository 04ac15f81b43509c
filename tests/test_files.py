"""Files, tables by id and checks of ids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinspark.operators import blocks, tables
from kinspark.sources import files

CODES = {2: 0, None: 1, 1: 2, 0: 3}


def write_bed(prefix, dosages):
    """dosages: a list of variants, each a list of copies or None."""
    people = len(dosages[0])
    raw = bytearray(b"\x6c\x1b\x01")
    for row in dosages:
        for at in range(0, people, 4):
            raw.append(sum(CODES[g] << (2 * k) for k, g in enumerate(row[at : at + 4])))
    prefix.with_suffix(".bed").write_bytes(bytes(raw))
    prefix.with_suffix(".fam").write_text("".join(f"f{i} {100 + i} 0 0 1 -9\n" for i in range(people)))
    prefix.with_suffix(".bim").write_text("".join(f"1\trs{k}\t0\t{k}\tA\tG\n" for k in range(len(dosages))))


@pytest.mark.parametrize("people", [1, 7, 8])
def test_bed(spark, tmp_path, people):
    rng = np.random.default_rng(3)
    dosages = [[[0, 1, 2, None][c] for c in rng.integers(0, 4, people)] for _ in range(150)]
    write_bed(tmp_path / "g", dosages)
    variants, order = files.read_bed(spark, str(tmp_path / "g"))
    assert {r.snp: list(r.dosage) for r in variants.collect()} == {f"rs{k}": row for k, row in enumerate(dosages)}
    assert {r.iid: r.position for r in order.collect()} == {100 + i: i for i in range(people)}
    some = files.read_bed(spark, str(tmp_path / "g"), spark.createDataFrame([("rs149",), ("rs3",), ("none",)], "snp string"))[0]
    assert {r.snp: list(r.dosage) for r in some.collect()} == {"rs149": dosages[149], "rs3": dosages[3]}


def test_bed_of_wrong_size_raises(spark, tmp_path):
    write_bed(tmp_path / "g", [[0, 1, 2, 0, 1]] * 3)
    with open(tmp_path / "g.bed", "ab") as f:
        f.write(b"\0")
    with pytest.raises(ValueError):
        files.read_bed(spark, str(tmp_path / "g"))


def test_tsv_and_weights(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("eid\tage\tname\n1\t50.5\ta b\n2\tNA\t\n")
    rows = files.read_tsv(spark, str(tmp_path / "t.tsv"), "eid long, age double, name string").orderBy("eid").collect()
    assert [tuple(r) for r in rows] == [(1, 50.5, "a b"), (2, None, None)]
    folder = tmp_path / "w"
    folder.mkdir()
    (folder / "a.txt").write_text("id\tallele\tweight\nrs1\tA\t0.5\nIntercept\t\t2.5\n")
    (folder / "b.txt").write_text("id\tallele\tweight\nrs2\tA\t-1\n")
    (folder / "c.csv").write_text("not,one\n")
    weights, intercept = files.read_weights(spark, str(folder))
    assert intercept == 2.5 and {tuple(r) for r in weights.collect()} == {("rs1", 0.5), ("rs2", -1.0)}
    (folder / "d.txt").write_text("id\tallele\tweight\nrs2\tA\t3\n")
    with pytest.raises(ValueError):
        files.read_weights(spark, str(folder))


def test_sample_file(spark, tmp_path):
    people = spark.createDataFrame([(10, 1.5, None), (9, 2.0, 3)], "iid long, age double, batch int")
    files.write_sample(people, ["age", "batch"], str(tmp_path / "s"))
    (part,) = (tmp_path / "s").glob("part-*")
    assert part.read_text() == "ID_1 ID_2 missing age batch \n0 0 0 D D \n9 9 0 2.0 3\n10 10 0 1.5 NA\n"


def test_result_sink_keeps_other_folders(spark, tmp_path):
    rows = lambda v: spark.createDataFrame(v, "protein string, chunk int, snp string, beta double")
    files.write_results(rows([("p", 0, "a", 1.0), ("p", 1, "b", 2.0)]), str(tmp_path / "r"))
    files.write_results(rows([("p", 1, "b", 3.0), ("q", 0, "c", 4.0)]), str(tmp_path / "r"))
    found = {(r.protein, r.chunk, r.snp, r.beta) for r in spark.read.parquet(str(tmp_path / "r")).collect()}
    assert found == {("p", 0, "a", 1.0), ("p", 1, "b", 3.0), ("q", 0, "c", 4.0)}


def test_checks_of_ids(spark):
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "iid long")
    tables.require_known(ids(1, 2, 2), ids(1, 2, 3), "iid")
    tables.require_same_ids(ids(1, 2), ids(2, 1), "iid")
    for left, right in ((ids(1, 2), ids(1)), (ids(1, 1), ids(1)), (ids(1, None), ids(1))):
        with pytest.raises(ValueError):
            tables.require_same_ids(left, right, "iid")
    with pytest.raises(ValueError):
        tables.require_known(ids(1, 4), ids(1), "iid")
    with pytest.raises(ValueError):
        tables.clean_names(spark.range(1).select(F.lit(1).alias("a b"), F.lit(2).alias("a-b")))


def test_standardised_constant_and_missing(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (3.0, 5.0, 1.0), (None, 5.0, 2.0)], "a double, b double, c double")
    rows = [tuple(r) for r in tables.standardised(df, ["a", "b"]).collect()]
    assert [r[1] for r in rows] == [None] * 3 and rows[2][0] is None and abs(rows[0][0] + rows[1][0]) < 1e-12 and rows[1][2] == 1.0


def test_repair_needs_six(spark):
    few = spark.range(5).withColumnRenamed("id", "iid")
    with pytest.raises(ValueError):
        blocks.repair_constant(spark.createDataFrame([], "snp string, iid long, g double"), spark.createDataFrame([("v",)], "snp string"), few)


def test_train_sample_within_ties(spark):
    people = spark.range(40).select((F.col("id") * 10007).alias("iid"), F.when(F.col("id") < 33, 1.0).alias("y"))
    split = {r.iid // 10007: r.split for r in tables.train_sample(people, "y", 0.5).collect()}
    assert len(split) == 40 and {k for k, v in split.items() if v == "train"} == set(range(16))


def test_forest_predicts(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 2))
    people = spark.createDataFrame([(i, float(a), float(b), float(a * 2 + b)) for i, (a, b) in enumerate(x)], "iid long, x1 double, x2 double, y double")
    split = tables.train_sample(people, "y", 0.5)
    found = tables.forest_surrogate(people, split, ["x1", "x2"], "y", trees=20)
    assert found.count() == 200
    assert found.join(people, "iid").select(F.corr("surrogate", "y")).first()[0] > 0.9


def test_lines_are_numbered_over_tasks(spark, tmp_path):
    n = 200_000
    (tmp_path / "g.bim").write_text("".join(f"1\trs{k}\t0\t{k}\tA\tG\n" for k in range(n)) + "\n")
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c in before:
            spark.conf.set(c, str(300_000))
        found = files._numbered(spark, str(tmp_path / "g.bim"), 1, "snp")
        assert found.filter("snp <> concat('rs', position)").count() == 0 and found.count() == n == found.select("position").distinct().count()
        assert found.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
