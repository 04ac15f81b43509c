"""Ranks, inverse-normal transform, screening and design columns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinspark.functions.normal import neg_log10_p, quantile

RANGE_ROWS = 50_000


def prefix_sums(counts: DataFrame, value: str, n: str) -> DataFrame:
    """Adds `before`, the sum of n over smaller values. Values are dealt to ranges, summed in each, and only the ranges' totals meet
    in one task, so no task sorts the whole column."""
    ranges = max(1, -(-counts.count() // RANGE_ROWS))
    dealt = counts.repartitionByRange(ranges, value).withColumn("_part", F.spark_partition_id()).checkpoint()
    order = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part").agg(F.sum(n).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_first"))
    own = Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.join(totals, "_part")
    return joined.withColumn("before", F.col("_first") + F.coalesce(F.sum(n).over(own), F.lit(0))).drop("_part", "_first")


def average_rank(df: DataFrame, value: str, into: str = "rank") -> DataFrame:
    """Ranks from 1, ties get their mean; null and NaN values get null."""
    known = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    counts = known.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    ranks = prefix_sums(counts, "_v", "_n").select("_v", (F.col("before") + (F.col("_n") + 1) / 2).alias(into))
    return df.join(ranks, df[value] == ranks["_v"], "left").drop("_v")


def inverse_normal(df: DataFrame, value: str, k: float = 0.375, into: str = "int") -> DataFrame:
    """The normal quantile of (rank - k) / (n - 2k + 1) among known values; unknown ones stay null."""
    ranked = average_rank(df, value, "_rank")
    n = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).count()
    return ranked.withColumn("_p", (F.col("_rank") - k) / F.lit(n - 2 * k + 1)).withColumn(into, F.expr(quantile("_p"))).drop("_rank", "_p")


def correlations(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """feature, corr with the target: null if any value of the two is missing. One pass for all columns."""
    aggs = [F.when(F.count(c) == F.count("*"), F.corr(c, target)).alias(c) for c in columns]
    row = df.agg(F.count("*").alias("_all"), F.count(target).alias("_y"), *aggs)
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("corr")) for c in columns])
    found = row.select("_all", "_y", F.explode(cells).alias("f"))
    return found.select("f.feature", F.when(F.col("_all") == F.col("_y"), F.col("f.corr")).alias("corr"))


#: Sums of tasks are added up in so many groups before they reach the driver.
SLOTS = 32


def _merged(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Of two sets of rows: n, means of x and y, and sums of squares and products about the means, a column per feature."""
    n = one[0] + two[0]
    share = np.divide(two[0], n, out=np.zeros_like(n), where=n > 0)
    dx, dy, weight = two[1] - one[1], two[2] - one[2], one[0] * share
    return np.stack((n, one[1] + dx * share, one[2] + dy * share, one[3] + two[3] + dx * dx * weight, one[4] + two[4] + dy * dy * weight, one[5] + two[5] + dx * dy * weight))


def wide_correlations(df: DataFrame, names: list[str], vector: str, target: str) -> DataFrame:
    """As correlations, for thousands of features that come as an array column: tasks add up arrays, so the plan does not grow with them. A feature without
    spread, or that lacks a value, has null, and so have all if the target lacks one. Arrays of other lengths raise."""
    width = len(names)

    def state(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n, mx, my = np.full(width, float(len(x))), x.mean(axis=0), y.mean()
        dx, dy = x - mx, y - my
        return np.stack((n, mx, np.full(width, my), (dx * dx).sum(axis=0), np.full(width, dy @ dy), dy @ dx))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, width))
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float)  # nulls are NaN, which spreads
                total = _merged(total, state(flat.reshape(batch.num_rows, width), batch.column(1).to_numpy(zero_copy_only=False).astype(float)))
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["state"])

    def merge(parts: pa.Table) -> pa.Table:
        total = reduce(_merged, (v.values.to_numpy().reshape(6, width) for v in parts.column("state")))
        return pa.table({"state": pa.array([total.ravel()], pa.list_(pa.float64()))})

    right = F.size(vector) == width
    x = F.when(right, F.col(vector).cast("array<double>")).otherwise(F.raise_error(F.lit(f"an array has other than {width} entries")))
    rows = df.select(x.alias("x"), F.col(target).cast("double").alias("y"))
    each = rows.mapInArrow(add, "state array<double>").withColumn("slot", F.spark_partition_id() % SLOTS)
    parts = each.groupBy("slot").applyInArrow(merge, "state array<double>").collect()
    with np.errstate(invalid="ignore", divide="ignore"):
        total = reduce(_merged, (np.array(r["state"]).reshape(6, width) for r in parts), np.zeros((6, width)))
        found = total[5] / np.sqrt(total[3] * total[4])
    return df.sparkSession.createDataFrame([(c, float(v) if np.isfinite(v) else None) for c, v in zip(names, found)], "feature string, corr double")


def top_k(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    """The k rows with the largest absolute value, nulls last."""
    return df.orderBy(F.abs(by).desc_nulls_last(), tie).limit(k)


def rank_sum(df: DataFrame, group: str, value: str) -> DataFrame:
    """Two-sided rank-sum test of value between group = 1 and 0, normal approximation with correction for ties and
    continuity: n1, n0, w, neg_log10_p (0 where one side is empty)."""
    known = df.filter(F.col(value).isNotNull() & F.col(group).isin(0, 1)).select(F.col(group).alias("_g"), F.col(value).alias("_v"))
    counts = known.groupBy("_v").agg(F.count("*").alias("_n"), F.sum("_g").alias("_one"))
    ranks = prefix_sums(counts, "_v", "_n").withColumn("_rank", F.col("before") + (F.col("_n") + 1) / 2)
    row = ranks.agg(
        F.coalesce(F.sum("_one"), F.lit(0)).cast("long").alias("n1"), F.coalesce(F.sum(F.col("_n") - F.col("_one")), F.lit(0)).cast("long").alias("n0"),
        F.sum(F.col("_rank") * F.col("_one")).alias("r1"), F.sum(F.pow(F.col("_n").cast("double"), 3) - F.col("_n")).alias("ties"),
    ).selectExpr("n1", "n0", "r1 - n1 * (n1 + 1) / 2 AS w", "ties", "cast(n1 + n0 AS double) AS n")
    z = row.selectExpr(
        "n1", "n0", "w", "w - n1 * n0 / 2 AS d", "n1 * n0 / 12e0 * ((n + 1) - ties / (n * (n - 1))) AS v",
    ).selectExpr("n1", "n0", "w", "pow(d - sign(d) * 0.5, 2) / v AS t")
    p = neg_log10_p("t")
    return z.selectExpr("n1", "n0", "w", f"CASE WHEN n1 = 0 OR n0 = 0 THEN 0e0 ELSE {p} END AS neg_log10_p")


def rank_sums(df: DataFrame, columns: list[str], value: str) -> DataFrame:
    """column, n1, n0, w, neg_log10_p of rank_sum for many columns of two values each, of any coding; of them the larger one is in place of 1. The value is ranked once
    and all columns are summed in one aggregation. Columns with more or fewer values have 0 and nulls. Rows without a value are left out; a column
    that lacks an entry among the others raises."""
    known = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(F.col(value).alias("_v"), *[F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate(columns)])
    known = known.checkpoint()
    counts = known.groupBy("_v").agg(F.count("*").alias("_n"))
    ties = counts.agg(F.sum(F.pow(F.col("_n").cast("double"), 3) - F.col("_n"))).first()[0] or 0.0
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{k}").alias("code")) for k, c in enumerate(columns)]))
    each = average_rank(known, "_v", "_rank").select("_rank", cells.alias("_c")).select("_rank", "_c.*")
    groups = each.groupBy("column", "code").agg(F.count("*").alias("n"), F.sum("_rank").alias("r"))
    both = groups.groupBy("column").agg(
        F.count("*").alias("codes"), F.count_if(F.col("code").isNull()).alias("missing"), F.max(F.struct("code", "n", "r")).alias("one"), F.min(F.struct("code", "n", "r")).alias("two")
    )
    both = both.withColumn("codes", F.when(F.col("missing") > 0, F.raise_error(F.concat(F.lit("missing entries in "), F.col("column")))).otherwise(F.col("codes")))
    z = both.select("column", "codes", F.col("one.n").alias("n1"), F.col("two.n").alias("n0"), (F.col("one.r") - F.expr("one.n * (one.n + 1) / 2")).alias("w"))
    z = z.withColumn("n", (F.col("n1") + F.col("n0")).cast("double")).selectExpr(
        "column", "codes", "n1", "n0", "w", "w - n1 * n0 / 2 AS d", f"n1 * n0 / 12e0 * ((n + 1) - {ties!r}D / nullif(n * (n - 1), 0)) AS v"
    ).selectExpr("column", "codes", "n1", "n0", "w", "pow(d - sign(d) * 0.5, 2) / nullif(v, 0) AS t")
    two = F.col("codes") == 2
    return z.select("column", *[F.when(two, F.col(c)).alias(c) for c in ("n1", "n0", "w")], F.when(two, F.coalesce(F.expr(neg_log10_p("t")), F.lit(0.0))).otherwise(0.0).alias("neg_log10_p"))


def one_hot(df: DataFrame, column: str, levels: list) -> DataFrame:
    """Treatment contrasts: a column for each level but the first."""
    return df.select("*", *[F.when(F.col(column) == level, 1).otherwise(0).alias(f"{column}_{level}") for level in levels[1:]])


def weighted_score(genotype: DataFrame, weights: DataFrame, intercept: float = 0.0, scale: float = 10.0, shift: float = 5.0) -> DataFrame:
    """iid, prs: sum of dosage times weight over the variants in both, / scale, + intercept / shift; missing dosages are 0."""
    joined = genotype.join(weights, "snp")
    total = F.sum(F.coalesce("g", F.lit(0.0)) * F.col("w"))
    return joined.groupBy("iid").agg((total / scale + F.lit(intercept / shift)).alias("prs"))
