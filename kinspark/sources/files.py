"""Files that association studies come in and go out as: tab-separated tables, relatedness, variant weights, binary dosages, samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinspark.operators.blocks import canonical
from kinspark.plans.session import prepare

#: Variants whose dosages are decoded at once.
BED_VARIANTS = 64
#: Bytes of a dosage file that one task reads, about.
BED_BYTES = 32 << 20
_BED_MAGIC = b"\x6c\x1b\x01"
#: Copies of the first allele by two-bit code; -1 is missing.
_COPIES = np.array([2, -1, 1, 0], np.int8)
_DECODE = _COPIES[(np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3]


def read_tsv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A tab-separated table with a header; "NA" and empty fields are null. A header that does not fit the schema raises."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema, nullValue="NA", enforceSchema=False)


def person(name: Column) -> Column:
    """The id before the first underscore."""
    return F.split(name, "_")[0].cast("long")


def relatedness(kinship: DataFrame) -> DataFrame:
    """i, j, k from names (i, j) such as 17_17 and kinship coefficients k, which are half the relatedness."""
    return canonical(kinship.select(person(F.col("i")).alias("i"), person(F.col("j")).alias("j"), (2 * F.col("k")).alias("k")))


def read_weights(spark: SparkSession, path: str, intercept: str = "intercept") -> tuple[DataFrame, float]:
    """(snp, w) and the intercept of the text files in a folder: the first column names a variant, the third holds its weight.
    The intercept's row is found by its name, in any case; there must be one. A variant that is named twice raises."""
    rows = spark.read.csv(path, sep="\t", header=True, pathGlobFilter="*.txt")
    rows = rows.toDF(*[f"c{k}" for k in range(len(rows.columns))]).select(F.col("c0").alias("snp"), F.col("c2").cast("double").alias("w"))
    own = F.lower("snp") == intercept.lower()
    found = [r["w"] for r in rows.filter(own).limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"the weights need one row named {intercept}")
    weights = rows.filter(~own)
    if not weights.groupBy("snp").count().filter("count > 1").isEmpty():
        raise ValueError("a variant has more than one weight")
    return weights, found[0]


def _numbered(spark: SparkSession, path: str, field: int, name: str) -> DataFrame:
    """position (line number from 0) and one field of a table without header. Tasks read the lines of their own bytes; lines are counted for each
    stretch of bytes, and only those counts meet in one task."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at")).checkpoint()
    stretches = lines.groupBy("_start").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.select("_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = lines.join(stretches, "_start").withColumn("position", (F.col("_before") + F.col("_at") - F.col("_first")).cast("int"))
    return placed.filter("trim(value) <> ''").select("position", F.split(F.trim("value"), r"\s+")[field].alias(name))


def read_bed(spark: SparkSession, prefix: str, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Variants (snp, position, dosage: one array of copies of the first allele, null where missing) and the order of the people (iid,
    position) of a variant-major .bed file with its .bim and .fam.

    Tasks read the bytes of their own variants; of the variants in `only` (snp), no others. The path must be one that pyarrow opens on
    every executor.
    """
    prepare(spark)
    order = _numbered(spark, f"{prefix}.fam", 1, "iid").select(person(F.col("iid")).alias("iid"), "position")
    variants = _numbered(spark, f"{prefix}.bim", 1, "snp").select("snp", "position")
    people, total = order.count(), variants.count()
    width = -(-people // 4)
    store, path = fs.FileSystem.from_uri(f"{prefix}.bed") if "://" in prefix else (fs.LocalFileSystem(), f"{prefix}.bed")
    size = store.get_file_info(path).size
    with store.open_input_file(path) as file:
        if file.read(3) != _BED_MAGIC or size != 3 + width * total:
            raise ValueError(f"{path} is not a variant-major file of {total} variants and {people} people")
    if only is not None:
        variants = variants.join(only.select("snp").distinct(), "snp", "left_semi")
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // BED_BYTES))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with store.open_input_file(path) as file:
            for batch in batches:
                for at in range(0, batch.num_rows, BED_VARIANTS):
                    part = batch.slice(at, BED_VARIANTS)
                    raw = b"".join(file.read_at(width, 3 + width * k) for k in part.column(1).to_pylist())
                    codes = _DECODE[np.frombuffer(raw, np.uint8)].reshape(part.num_rows, 4 * width)[:, :people]
                    flat = np.ascontiguousarray(codes).ravel()
                    offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * np.int32(people))
                    lists = pa.ListArray.from_arrays(offsets, pa.array(flat, mask=flat < 0))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["snp", "position", "dosage"])

    dealt = variants.repartitionByRange(tasks, "position").sortWithinPartitions("position")
    return dealt.mapInArrow(read, "snp string, position int, dosage array<tinyint>"), order


def sample_lines(people: DataFrame, covariates: list[str], iid: str = "iid") -> DataFrame:
    """at, id, line of a sample file: names, types (0 for the id columns, D for covariates), then a row a person; missing values are NA.
    The two lines of the header end with a space."""
    spark = people.sparkSession
    names, types = ["ID_1", "ID_2", "missing", *covariates], ["0"] * 3 + ["D"] * len(covariates)
    kind = dict(people.dtypes)[iid]
    head = spark.createDataFrame([(k, " ".join(x) + " ") for k, x in enumerate((names, types))], "at int, line string")
    head = head.select("at", F.lit(None).cast(kind).alias("id"), "line")
    cells = [F.col(iid).cast("string"), F.col(iid).cast("string"), F.lit("0"), *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in covariates]]
    return head.unionByName(people.select(F.lit(2).alias("at"), F.col(iid).alias("id"), F.concat_ws(" ", *cells).alias("line")))


def write_sample(people: DataFrame, covariates: list[str], path: str, iid: str = "iid") -> None:
    """The lines as one text file in the folder `path`, people in order of their ids. Such a file has a line per person."""
    lines = sample_lines(people, covariates, iid).repartition(1).sortWithinPartitions("at", "id")
    lines.select("line").write.mode("overwrite").text(path)


def write_results(results: DataFrame, path: str, by: tuple[str, ...] = ("protein", "chunk")) -> None:
    """Results as Parquet, a folder for each value of `by`; folders that the results do not touch stay as they are."""
    shuffled = results.repartition(*by)
    shuffled.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
