"""Exact deduplication with a split of heavy hitters.

Misra-Gries counters (Spark's `freqItems`) name the digests that may hold more than a given share
of all rows. Their true counts are verified, and the few winners are broadcast, so that rows of huge groups
of copies are decided where they lie. The other digests, none of which is frequent, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, prepare, unused

#: A digest with at least this share of the rows counts as heavy. At most 1/SUPPORT digests are broadcast.
SUPPORT = 1 / 2000


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_sha256 of the normalised text, and a number that tells repeated rows apart."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(ascii_lower(F.col(text_col)), 256).alias("text_sha256"),
        F.monotonically_increasing_id().alias("_row"),
    )


def heavy_digests(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Digests with at least `support` of the rows: text_sha256, group_size, keep (the row that stays)."""
    least = F.lit(rows.count() * support)
    counters = rows.stat.freqItems(["text_sha256"], support)
    candidates = counters.select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    return (
        rows.join(F.broadcast(candidates), "text_sha256")
        .groupBy("text_sha256")
        .agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "_row")).alias("keep"))
        .filter((F.col("group_size") >= least) & (F.col("group_size") > 1))
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical after lower-casing A-Z. A null text is the empty text. Of equal texts the
    row with the largest doc_id stays; a null doc_id is smaller than any other, and of rows that
    repeat the same doc_id and text exactly one stays. Other columns of the input, whatever their names, are not read.
    An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    rows = digests(docs, id_col, text_col).checkpoint()
    heavy = heavy_digests(rows, support).checkpoint()
    in_heavy = rows.join(F.broadcast(heavy), "text_sha256")
    light = rows.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
    group = Window.partitionBy("text_sha256")
    in_light = light.withColumn("group_size", F.count("*").over(group)).withColumn(
        "keep", F.max(F.struct("doc_id", "_row")).over(group)
    )
    return in_heavy.unionByName(in_light).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("keep._row")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names. Of rows with one doc_id and text, one stays.

    A null text is empty. An empty table stays empty. Texts of any length are hashed whole.
    """
    decided = exact_dedup(docs, id_col, text_col, support)
    same = unused(docs, "_kept_id", "_sha")
    own_id, sha = same
    kept = decided.select(F.col("doc_id").alias(own_id), F.col("text_sha256").alias(sha), "kept").groupBy(*same).agg(
        F.bool_or("kept").alias("_stays"), F.count("*").alias("_copies")
    ).filter("_stays").checkpoint()
    keyed = docs.withColumn(sha, F.sha2(ascii_lower(F.col(text_col)), 256)).withColumn(own_id, F.col(id_col))
    match = lambda rows: [keyed[own_id].eqNullSafe(rows[own_id]), keyed[sha] == rows[sha]]
    once, repeated = kept.filter("_copies = 1"), kept.filter("_copies > 1")
    stay = keyed.join(once, match(once), "left_semi")
    if not repeated.isEmpty():
        stay = stay.unionByName(keyed.join(repeated, match(repeated), "left_semi").dropDuplicates(same))
    return stay.drop(*same)
