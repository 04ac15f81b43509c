"""The cohort, its relatedness and dosages, derived from the tables by a fixed recipe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspark.plans.session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """iid, family (pairs of neighbours), x1, x2, s, y, y_obs: the first four tenths of the ids are observed."""
    customers = table(spark, sf_dir, "customer")
    n = customers.count()
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("x2"), F.avg("o_totalprice").alias("spent"))
    joined = customers.join(orders, customers["c_custkey"] == orders["o_custkey"], "left")
    family = F.floor(F.col("c_custkey") / 2)
    base = joined.select(
        F.col("c_custkey").alias("iid"), family.alias("family"), F.col("c_nationkey").cast("double").alias("x1"),
        F.coalesce("x2", F.lit(0)).cast("double").alias("x2"), ((family * 37) % 11).cast("double").alias("fe"),
        F.coalesce("spent", F.lit(0.0)).alias("spent"), "c_acctbal",
    ).withColumn("y", F.col("c_acctbal") / 1000 + F.col("fe") / 2)
    s = 0.5 * F.col("y") + F.col("spent") / 100000 + F.col("fe") / 4
    return base.select("iid", "family", "x1", "x2", s.alias("s"), "y", F.when(F.col("iid") * 10 < n * 4, F.col("y")).alias("y_obs"))


def pair_grm(people: DataFrame) -> DataFrame:
    """i, j, k: 1 on the diagonal, 0.5 between the members of a family; both triangles."""
    members = people.select("family", F.col("iid").alias("i")).join(people.select("family", F.col("iid").alias("j")), "family")
    return members.select("i", "j", F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.5).alias("k"))


def brand_dosages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snp, iid, g: line items of a brand that a customer bought, at most 2. Dosages of 0 have no row."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    bought = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return bought.groupBy(F.col("p_brand").alias("snp"), F.col("o_custkey").alias("iid")).agg(F.least(F.count("*"), F.lit(2)).cast("double").alias("g"))


def part_dosages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snp, iid, g: large line items of a part that a customer bought, at most 2. Most parts have few carriers."""
    items = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select("l_orderkey", F.col("l_partkey").alias("snp"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("iid"))
    bought = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return bought.groupBy("snp", "iid").agg(F.least(F.count("*"), F.lit(2)).cast("double").alias("g"))
