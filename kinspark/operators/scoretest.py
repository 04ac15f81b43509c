"""Score tests of many variants.

Dosages and people meet in tiles of some variants and the people of one bucket, or, where dosages come as one array per variant, in
the variant's own row. Either way a variant ends up as one row of sums, from which its test follows by algebra on small arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinspark.functions.normal import CHI2_MEDIAN, neg_log10_p

from . import families as fam
from .nullmodel import NullModel

RESULT = ("snp", "t_score", "neg_log10_p", "beta", "var_beta")
#: Variants of one tile, about.
TILE_VARIANTS = 500
#: A model up to this size is sent to all executors for dosages that come as arrays; beyond it they are taken apart.
MOST_BYTES = 512 << 20
#: Variants of an array batch that are worked on at once.
BATCH_VARIANTS = 100


def dealt(genotype: DataFrame, members: DataFrame, variants: int | None, extra: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Dosages, and people repeated for each tile, with the columns tile and bucket."""
    if variants is None:
        # read twice, so made once
        genotype = genotype.select("snp", "iid", "g", *extra).checkpoint()
        variants = genotype.select(F.approx_count_distinct("snp")).first()[0]
    tiles = max(1, -(-variants // TILE_VARIANTS))
    tile = F.pmod(F.xxhash64("snp"), F.lit(tiles)).cast("int")
    rows = genotype.join(members.select("iid", "bucket"), "iid").select(tile.alias("tile"), F.col("bucket").alias("bucket"), "snp", "iid", F.col("g").cast("double").alias("g"), *extra)
    every = members.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    return rows, every


def tile(genotype: pa.Table, people: pa.Table) -> tuple[pa.Array, np.ndarray, pa.Table]:
    """The variants of a tile, their dense dosages (variants x people), and people sorted by block and id."""
    people = people.sort_by([("block", "ascending"), ("iid", "ascending")]).combine_chunks()
    iid = people.column("iid").to_numpy()
    snp = genotype.column("snp").combine_chunks().dictionary_encode()
    snp = snp.combine_chunks() if isinstance(snp, pa.ChunkedArray) else snp
    by_id = np.argsort(iid)
    g = np.zeros((len(snp.dictionary), len(iid)))
    at = by_id[np.searchsorted(iid[by_id], genotype.column("iid").to_numpy())]
    g[snp.indices.to_numpy(), at] = genotype.column("g").fill_null(0.0).to_numpy()
    return snp.dictionary, g, people


def _flat(table: pa.Table, name: str) -> pa.ListArray:
    column = table.column(name).combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def sums_of(g: np.ndarray, people: pa.Table, n_forms: int) -> np.ndarray:
    """For each variant g'w for all weights, then the quadratic forms."""
    w = np.stack(people.column("w").to_numpy()) if people.num_rows else np.zeros((0, 0))
    out = [g @ w]
    block, rows = people.column("block").to_numpy(), _flat(people, "f")
    found = fam.from_flat(block, rows, n_forms)
    squares = np.zeros((len(g), n_forms))
    for f in range(n_forms):
        for members, forms in found:
            squares[:, f] += fam.quadratic(g, members, forms[f])
    for large, seen, variances in fam.large_from_flat(block, rows, n_forms > 1):
        squares += large.quadratics(g[:, large.members], seen, variances)
    out.append(squares)
    return np.concatenate(out, axis=1)


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel()))


def _type(genotype: DataFrame) -> T.DataType:
    return genotype.schema["snp"].dataType


def _schema(genotype: DataFrame, *columns: str) -> T.StructType:
    kinds = {"sums": T.ArrayType(T.DoubleType()), "num": T.DoubleType(), "info": T.DoubleType(), "var": T.DoubleType()}
    return T.StructType([T.StructField("snp", _type(genotype)), *[T.StructField(c, kinds[c]) for c in columns]])


def functionals(genotype: DataFrame, model: NullModel, variants: int | None = None) -> DataFrame:
    """snp, sums: an array per bucket. genotype: snp, iid, g with one row for a snp and person at most, and none for dosages of 0."""
    rows, people = dealt(genotype, model.members, variants)
    n_forms, width = model.n_forms, model.width
    names = genotype.schema["snp"].dataType

    def work(dosages: pa.Table, members: pa.Table) -> pa.Table:
        if not dosages.num_rows:
            return pa.table({"snp": pa.array([], dosages.schema.field("snp").type), "sums": _lists(np.zeros((0, width)))})
        snp, g, members = tile(dosages, members)
        return pa.table({"snp": snp, "sums": _lists(sums_of(g, members, n_forms))})

    schema = T.StructType([T.StructField("snp", names), T.StructField("sums", T.ArrayType(T.DoubleType()))])
    return rows.groupBy("tile", "bucket").cogroup(people.groupBy("tile", "bucket")).applyInArrow(work, schema)


def added(parts: pa.ListArray) -> np.ndarray:
    """Lists of lists of equal length: a row for each outer list, the sum of its inner ones."""
    outer = parts.offsets.to_numpy()
    inner = parts.values
    width = inner.offsets[1].as_py() - inner.offsets[0].as_py() if len(inner) else 0
    flat = inner.flatten().to_numpy().reshape(len(inner), width)
    first = outer[0]
    return np.add.reduceat(flat, outer[:-1] - first) if len(flat) else np.zeros((0, width))


def finished(found: DataFrame, keys: tuple[str, ...] = ("snp",)) -> DataFrame:
    """(snp, num, info, var) to RESULT; a variant that the covariates explain gets nulls."""
    clean = found.select(*keys, *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("num", "info", "var")])
    done = clean.select(*keys, (F.col("num") * F.col("num") / F.col("var")).alias("t_score"), (F.col("num") / F.col("info")).alias("beta"), (F.col("var") / (F.col("info") * F.col("info"))).alias("var_beta"))
    return done.withColumn("neg_log10_p", F.expr(neg_log10_p("t_score"))).select(*keys, *RESULT[1:])


def _native_tests(genotype: DataFrame, model: NullModel) -> DataFrame:
    """snp, num, info, var for unrelated people: a join and sums, and families.finish as expressions over them."""
    p, arrays, width = model.p, model.arrays, model.width - model.n_forms
    dims = range(p)
    # the weights of x by h, and by its transpose, are the same where forms are numbers
    used = [k for k in range(width) if k < 2 + 3 * p]
    people = model.members.select("iid", *[F.col("w")[k].alias(f"w{k}") for k in used], *[F.col("f")[k].alias(f"f{k}") for k in range(model.n_forms)])
    g = F.coalesce(F.col("g").cast("double"), F.lit(0.0))
    rows = genotype.select("snp", "iid", g.alias("g")).join(people, "iid").groupBy("snp").agg(
        *[F.sum(F.col("g") * F.col(f"w{k}")).alias(f"w{k}") for k in used], *[F.sum(F.col("g") * F.col("g") * F.col(f"f{k}")).alias(f"f{k}") for k in range(model.n_forms)]
    )
    col = lambda k: F.col(f"w{k}")
    dot = lambda a, b: sum((x * y for x, y in zip(a, b)), F.lit(0.0))
    numbers = lambda a: [F.lit(float(v)) for v in a]
    times = lambda m, name: [dot(numbers(row), [F.col(f"{name}{j}") for j in dims]) for row in m]

    def named(df: DataFrame, name: str, columns: list) -> DataFrame:
        return df.select("*", *[c.alias(f"{name}{i}") for i, c in enumerate(columns)])

    vec = lambda name: [F.col(f"{name}{i}") for i in dims]
    rows = named(rows, "a", [col(1 + i) for i in dims])
    rows = named(rows, "am", times(arrays["a22"], "a"))
    rows = rows.withColumn("own", F.col("f0") - dot(vec("a"), vec("am")))
    if model.kind == "single":
        rows = rows.select("snp", (col(0) - dot(vec("am"), numbers(arrays["bx"]))).alias("num"), F.col("own").alias("info"), F.col("own").alias("var"))
    else:
        rows = named(named(rows, "c", [col(2 + p + i) for i in dims]), "l", [col(2 + 2 * p + i) for i in dims])
        rows = named(rows, "ga", times(arrays["c"], "c"))
        rows = rows.withColumn("info", F.col("f1") - dot(vec("c"), vec("ga"))).withColumn("dg", F.col("f2") - dot(vec("ga"), vec("l")))
        rows = rows.withColumn("alpha", F.when(F.col("own") > 1e-9, (col(0) - dot(vec("am"), numbers(arrays["bx"]))) / F.col("own")))
        rows = named(rows, "dx", [F.col(f"l{i}") - v for i, v in enumerate(times(arrays["vdx"].T, "ga"))])
        fitted = [F.lit(float(v)) - F.col(f"am{i}") * F.col("alpha") for i, v in enumerate(arrays["a22"] @ arrays["bx"])]
        num = col(1 + p) - dot(vec("ga"), numbers(arrays["vr"])) + F.col("dg") * F.col("alpha") + dot(vec("dx"), fitted)
        var = F.col("info") + dot(vec("dx"), times(arrays["a22"], "dx")) + F.pow(F.col("dg") - dot(vec("dx"), vec("am")), 2) / F.when(F.col("own") > 1e-9, F.col("own"))
        rows = rows.select("snp", num.alias("num"), "info", var.alias("var"))
    good = (F.col("info") > 1e-9) & (F.col("var") > 1e-9)
    return rows.select("snp", *[F.when(good, F.col(c)).alias(c) for c in ("num", "info", "var")])


def score(genotype: DataFrame, model: NullModel, variants: int | None = None) -> DataFrame:
    """One row per variant with a dosage in the model's people: RESULT. genotype: snp, iid, g, without rows for dosages of 0; null
    dosages count as 0. variants: about how many there are, where known."""
    if not model.related:
        return finished(_native_tests(genotype, model))
    arrays, p = model.arrays, model.p
    parts = functionals(genotype, model, variants).groupBy("snp").agg(F.collect_list("sums").alias("sums"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = fam.finish(added(batch.column(1)), arrays, p) if batch.num_rows else np.zeros((0, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in done.T]], ["snp", "num", "info", "var"])

    return finished(parts.mapInArrow(test, _schema(genotype, "num", "info", "var")))


def model_bytes(model: NullModel) -> int:
    """Size of a model's rows: 8 bytes for each weight and each form's entry."""
    row = model.members.agg(F.sum(F.size("w") + F.size("f") + 3)).first()
    return 8 * (row[0] or 0)


def score_arrays(variants: DataFrame, order: DataFrame, model: NullModel, most_bytes: int = MOST_BYTES) -> DataFrame:
    """RESULT for dosages of one array per variant: variants has snp and dosage, order has iid and position (its place in the arrays,
    from 0). Null dosages count as 0. A person of the model who has no place raises.

    The model is broadcast if it has up to most_bytes, and no dosage is shuffled; a larger one meets slices of the dosages.
    """
    placed = model.members.join(order.select("iid", "position"), "iid", "left")
    missing = placed.filter("position is null").count()
    if missing:
        raise ValueError(f"{missing} people of the model are not among the genotyped")
    if model_bytes(model) > most_bytes:
        from .slices import score_slices

        found = score_slices(variants, order, {"m": model})
        return found.select("snp", *[F.col(f"m_{c}").alias(c) for c in RESULT[1:]])
    spark = variants.sparkSession
    table = placed.select("iid", "block", "position", "w", "f").toArrow().sort_by([("block", "ascending"), ("iid", "ascending")])
    shared = spark.sparkContext.broadcast(table.combine_chunks())
    arrays, p, n_forms = model.arrays, model.p, model.n_forms

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        people = shared.value
        position = people.column("position").to_numpy()
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_VARIANTS):
                part = batch.slice(at, BATCH_VARIANTS)
                dosage = part.column(1)
                flat = pc.fill_null(dosage.flatten().cast(pa.float64()), 0.0).to_numpy()
                g = flat.reshape(part.num_rows, -1)[:, position]
                done = fam.finish(sums_of(g, people, n_forms), arrays, p)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c) for c in done.T]], ["snp", "num", "info", "var"])

    return finished(variants.select("snp", "dosage").mapInArrow(test, _schema(variants, "num", "info", "var")))


def calibration(results: DataFrame) -> DataFrame:
    """variants, lambda_gc, median_neg_log10_p, share_05, share_01, mean_beta of a scan."""
    share = lambda level: F.avg((F.col("neg_log10_p") > -float(np.log10(level))).cast("double"))
    return results.filter("t_score is not null").agg(
        F.count("*").alias("variants"), (F.percentile("t_score", F.lit(0.5)) / CHI2_MEDIAN).alias("lambda_gc"),
        F.percentile("neg_log10_p", F.lit(0.5)).alias("median_neg_log10_p"), share(0.05).alias("share_05"), share(0.01).alias("share_01"), F.avg("beta").alias("mean_beta"),
    )
