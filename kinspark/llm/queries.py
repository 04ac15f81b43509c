"""The registered queries of the corpus operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, fertility, license_scan, nearest, packing, quality_gbt, secret_scan, simhash, substring_dedup, token_alignment, tool_calls, whitening
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = lambda s: F.concat_ws(":", s["label"], s["start"].cast("string"), s["end"].cast("string"), s["edits"].cast("string"))
    return license_scan.license_scan(table(spark, sf_dir, "documents")).withColumn("spans", F.array_join(F.transform("spans", place), ","))


def op4_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gbt.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.exchanges(table(spark, sf_dir, "conversations"))
    return tool_calls.link_calls(calls, results, tool_calls.EXCHANGE_TOOLS)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("repo", F.concat_ws("/", "source", "lang"))
    return secret_scan.secret_scan(docs, repo_col="repo", owner_col="source").drop("live")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, model = table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    second = {"ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
    return fertility.learnt_rules(docs, table(spark, sf_dir, "labels"), model, **second)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment.alignment(table(spark, sf_dir, "documents"), one, two)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_rows(table(spark, sf_dir, "embeddings"))


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_bpe, op2_simhash, op3_license_scan, op4_quality_trees, op5_substring_dedup, op6_tool_calls, op7_secret_scan,
        op8_exact_dedup, op9_packing, op10_fertility_rules, op11_token_alignment, op12_whitening, op13_nearest,
    )
}
