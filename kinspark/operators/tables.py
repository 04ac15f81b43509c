"""Tables side by side by id, checks of ids, and columns made ready for models."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import chosen_order

METHOD_COLUMNS = ("neg_log10_p", "beta", "var_beta")


def side_by_side(results: dict[str, DataFrame]) -> DataFrame:
    """snp, and for each method its three columns, named method_column. Variants that a method lacks have nulls there."""
    named = [r.select("snp", *[F.col(c).alias(f"{m}_{c}") for c in METHOD_COLUMNS]) for m, r in results.items()]
    return reduce(lambda a, b: a.join(b, "snp", "full"), named)


def require_known(rows: DataFrame, known: DataFrame, key: str) -> None:
    """Raises if a key of rows is not in known."""
    missing = rows.select(key).distinct().join(known, key, "left_anti")
    if not missing.isEmpty():
        raise ValueError(f"{missing.count()} values of {key} are unknown, such as {missing.first()[0]}")


def require_same_ids(left: DataFrame, right: DataFrame, key: str) -> None:
    """Raises unless both have the same keys, each once."""
    one, two = (t.groupBy(key).agg(F.count("*").alias(n)) for t, n in ((left, "_l"), (right, "_r")))
    joined = one.join(two, one[key].eqNullSafe(two[key]), "full")
    bad = joined.filter("NOT (_l <=> 1 AND _r <=> 1)").count()
    if bad:
        raise ValueError(f"{bad} values of {key} are repeated or on one side only")


def clean_names(df: DataFrame) -> DataFrame:
    """Spaces and hyphens in column names become underscores; two names that become equal raise."""
    names = [re.sub("[- ]", "_", c) for c in df.columns]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError("two columns have the same name once cleaned")
    return df.toDF(*names)


def standardised(df: DataFrame, columns: list[str], spread: bool = True) -> DataFrame:
    """Columns minus their mean and, with spread, over their deviation (n - 1). Missing values stay so; constant columns become null."""
    row = df.agg(*[f(c) for c in columns for f in (F.avg, F.stddev_samp)]).first()  # two numbers a column
    done = {}
    for c, mean, sd in zip(columns, row[::2], row[1::2]):
        scale = sd if spread else 1.0
        done[c] = (F.col(c) - F.lit(mean)) / F.lit(scale) if scale and mean is not None else F.lit(None).cast("double")
    return df.withColumns(done)


def factor(df: DataFrame, column: str, levels: list, into: str) -> DataFrame:
    """The place of a value among the levels, from 1; other values and nulls become null."""
    at = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(column)).cast("int")
    return df.withColumn(into, F.nullif(at, F.lit(0)))


def covariances(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, cov: sample covariances (n - 1) of all pairs of columns, in one pass."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k:]]
    row = df.agg(*[F.covar_samp(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("cov")) for k, (a, b) in enumerate(pairs)])
    return row.select(F.explode(cells).alias("c")).select("c.a", "c.b", "c.cov")


def train_sample(people: DataFrame, observed: str, share: float = 0.1, seed: int = 3) -> DataFrame:
    """iid, split: of the n ids that are observed, floor(share * n) are "train" by a fixed arithmetic order; all others are "test".

    Only the counts of the order's values, at most as many as its modulus, meet in one task, and only ids at the cut are ranked.
    """
    rows = people.select("iid", F.when(F.col(observed).isNotNull(), chosen_order(F.col("iid"), seed)).alias("_o"))
    wanted = F.lit(math.floor(share * rows.filter("_o IS NOT NULL").count()))
    counts = rows.filter("_o IS NOT NULL").groupBy("_o").count()
    before = F.sum("count").over(Window.orderBy("_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("count")
    room = counts.select("_o", (wanted - before).alias("_room"))
    joined = rows.join(room, "_o", "left")
    inside = joined.filter("_room >= 1")
    cut = inside.join(counts, "_o").filter("_room < count")
    rank = F.row_number().over(Window.partitionBy("_o").orderBy("iid"))
    late = cut.withColumn("_rank", rank).filter("_rank > _room").select("iid")
    train = inside.select("iid").join(late, "iid", "left_anti").withColumn("split", F.lit("train"))
    return people.select("iid").join(train, "iid", "left").select("iid", F.coalesce("split", F.lit("test")).alias("split"))


def forest_surrogate(people: DataFrame, split: DataFrame, features: list[str], target: str, trees: int = 300, depth: int = 8, seed: int = 1) -> DataFrame:
    """iid, surrogate: a random forest is fitted to the people of "train" and predicts all of "test". Missing features raise."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    rows = VectorAssembler(inputCols=features, outputCol="_features").transform(people.select("iid", *features, F.col(target).alias("_target")).join(split, "iid"))
    forest = RandomForestRegressor(featuresCol="_features", labelCol="_target", predictionCol="surrogate", numTrees=trees, maxDepth=depth, seed=seed)
    model = forest.fit(rows.filter("split = 'train'"))
    return model.transform(rows.filter("split = 'test'")).select("iid", "surrogate")
