"""The corpus pipeline: documents are judged, deduplicated, cleaned of live secrets and packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result as Parquet in the shared folder and
reads it again for the next stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspark.llm import exact_dedup, packing, quality_gbt, secret_scan, simhash_similar
from kinspark.llm.common import prepare, table, unused


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    model = quality_gbt.fit(docs, table(spark, sf_dir, "labels"))
    (score,) = unused(docs, "_score")
    return quality_gbt.score(docs, model, into=score).filter(F.col(score) >= quality_gbt.THRESHOLD).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more), the document with the smallest doc_id stays."""
    return simhash_similar.keep_first(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets that look live; all documents stay, and n_chars follows the text."""
    columns = docs.columns
    repo, before = unused(docs, "_repo", "_before")
    placed = docs.withColumn(repo, F.concat_ws("/", "source", "lang")).withColumn(before, F.xxhash64("text"))
    clean = secret_scan.redact(placed, repo_col=repo, owner_col="source")
    changed = F.xxhash64("text") != F.col(before)
    return clean.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", keep_good),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

#: The classifier, fingerprints and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{folder}/{name}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
