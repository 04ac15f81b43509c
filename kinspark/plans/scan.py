"""The whole path of a study: dosage files in, scores of several models, results out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspark.operators import blocks, tables
from kinspark.operators.nullmodel import NullModel
from kinspark.operators.slices import score_slices
from kinspark.sources import files

from .session import prepare

#: People of one piece of a sum over variants.
PIECE_PEOPLE = 1 << 14


def array_score(variants: DataFrame, order: DataFrame, weights: DataFrame, intercept: float = 0.0, scale: float = 10.0, shift: float = 5.0) -> DataFrame:
    """iid, prs of all people in order (iid, position): prep.weighted_score for dosages of one array per variant. A variant in weights that has no dosages raises."""
    tables.require_known(weights.select("snp"), variants.select("snp"), "snp")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                flat = pc.fill_null(batch.column(0).flatten().cast(pa.float64()), 0.0).to_numpy()
                part = batch.column(1).to_numpy() @ flat.reshape(batch.num_rows, -1)
                total = part if total is None else total + part
        if total is not None:
            cuts = range(0, len(total), PIECE_PEOPLE)
            sums = pa.array([total[at : at + PIECE_PEOPLE] for at in cuts], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([at // PIECE_PEOPLE for at in cuts], pa.int32()), sums], ["piece", "sums"])

    def merge(rows: pa.Table) -> pa.Table:
        total = sum(v.values.to_numpy() for v in rows.column("sums"))
        return pa.table({"piece": rows.column("piece")[:1], "sums": pa.array([total], pa.list_(pa.float64()))})

    schema = "piece int, sums array<double>"
    sums = variants.join(weights.select("snp", F.col("w").cast("double")), "snp").select("dosage", "w").mapInArrow(add, schema).groupBy("piece").applyInArrow(merge, schema)
    each = sums.select("piece", F.posexplode("sums").alias("at", "total")).select((F.col("piece") * PIECE_PEOPLE + F.col("at")).alias("position"), "total")
    found = order.select("iid", "position").join(each, "position", "left")
    return found.select("iid", (F.coalesce("total", F.lit(0.0)) / scale + F.lit(intercept / shift)).alias("prs"))


def scan_files(
    spark: SparkSession, prefix: str, models: dict[str, NullModel], path: str, protein: str, only: DataFrame | None = None, observed: DataFrame | None = None,
    chunk: int = 200,
) -> None:
    """Reads prefix.bed, .bim and .fam, tests the variants (those of `only`, all of which must exist) against all models, and writes a row per variant,
    with each model's columns, to path, in a folder for each protein and chunk of variants that follow each other; folders of other proteins stay. Variants that
    are constant among the `observed` people (iid) get varied dosages first; without `observed` they have nulls."""
    prepare(spark)
    variants, order = files.read_bed(spark, prefix, only)
    if only is not None:
        tables.require_known(only, variants.select("snp"), "snp")
    found = score_slices(variants, order, models, observed)
    chunks = blocks.variant_chunks(variants.select("snp", "position"), 1, chunk).select("snp", "chunk")
    files.write_results(found.join(chunks, "snp").withColumn("protein", F.lit(protein)), path)
