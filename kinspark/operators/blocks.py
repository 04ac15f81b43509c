"""Relatedness: the sparse matrix, its blocks, and what is chosen by block."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prep import prefix_sums

#: Ids of one task of the running maximum.
SPAN = 1 << 16


def canonical(grm: DataFrame) -> DataFrame:
    """Both triangles of (i, j, k), each entry once, without stored zeros."""
    both = grm.select("i", "j", "k").unionByName(grm.select(F.col("j").alias("i"), F.col("i").alias("j"), "k"))
    return both.filter("k <> 0").groupBy("i", "j").agg(F.max("k").alias("k"))


def density(grm: DataFrame, n: int) -> DataFrame:
    return grm.agg((F.count("*") / F.lit(float(n) * n)).alias("density"))


def submatrix(grm: DataFrame, ids: DataFrame) -> DataFrame:
    """The entries whose row and column are both in ids (iid)."""
    rows, columns = ids.select(F.col("iid").alias("i")), ids.select(F.col("iid").alias("j"))
    return grm.join(rows, "i", "left_semi").join(columns, "j", "left_semi").select("i", "j", "k")


def blocks(ids: DataFrame, grm: DataFrame, threshold: float | None = None) -> DataFrame:
    """iid, block_id (smallest id): contiguous ranges that no entry crosses; entries below the threshold don't count.

    The running maximum of the largest neighbour is taken in two levels, so that no task reads all ids.
    """
    edges = grm if threshold is None else grm.filter(F.abs("k") >= threshold)
    reach = ids.select(F.col("iid").alias("i")).join(edges.groupBy("i").agg(F.max("j").alias("m")), "i", "left")
    reach = reach.select("i", F.greatest("i", F.coalesce("m", "i")).alias("m"), F.floor(F.col("i") / SPAN).alias("part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("part").orderBy("i")
    tops = reach.groupBy("part").agg(F.max("m").alias("top")).select("part", F.max("top").over(before).alias("top"))
    run = reach.join(tops, "part").withColumn("run", F.greatest(F.max("m").over(own), F.coalesce("top", F.lit(-1))))
    # a block starts at an id that nothing before it reaches
    prior = F.coalesce(F.lag("run").over(own), F.coalesce("top", F.lit(-1)))
    starts = run.withColumn("start", F.when(prior < F.col("i"), F.col("i")))
    lasts = starts.groupBy("part").agg(F.max("start").alias("s")).select("part", F.max("s").over(before).alias("earlier"))
    found = F.coalesce(F.max("start").over(own), "earlier")
    return starts.join(lasts, "part").select(F.col("i").alias("iid"), found.alias("block_id"))


def chosen_order(iid: Column, seed: int) -> Column:
    """A fixed arithmetic order that stands for a random one."""
    return (iid * 7919 + seed) % 10007


def largest_blocks(ids: DataFrame, grm: DataFrame, thresholds: list[float]) -> DataFrame:
    """level (place of the threshold, from 0), largest: the size of the largest block at each of some rising thresholds, by one scan of the entries. An entry
    counts up to the last threshold that it reaches, and each level has a running maximum of its own."""
    levels = len(thresholds)
    reached = sum((F.when(F.abs("k") >= t, 1).otherwise(0) for t in thresholds), F.lit(0))
    far = grm.withColumn("_reached", reached).filter("_reached > 0").groupBy("i").agg(
        *[F.max(F.when(F.col("_reached") > level, F.col("j"))).alias(f"m{level}") for level in range(levels)]
    )
    each = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), F.col(f"m{level}").alias("m")) for level in range(levels)]))
    rows = ids.select(F.col("iid").alias("i")).join(far, "i", "left").select("i", each.alias("_e")).select("i", "_e.level", "_e.m")
    reach = rows.select("level", "i", F.greatest("i", F.coalesce("m", "i")).alias("m"), F.floor(F.col("i") / SPAN).alias("part"))
    before = Window.partitionBy("level").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("level", "part").orderBy("i")
    tops = reach.groupBy("level", "part").agg(F.max("m").alias("top")).select("level", "part", F.max("top").over(before).alias("top"))
    run = reach.join(tops, ["level", "part"]).withColumn("run", F.greatest(F.max("m").over(own), F.coalesce("top", F.lit(-1))))
    prior = F.coalesce(F.lag("run").over(own), F.coalesce("top", F.lit(-1)))
    starts = run.withColumn("start", F.when(prior < F.col("i"), F.col("i")))
    lasts = starts.groupBy("level", "part").agg(F.max("start").alias("s")).select("level", "part", F.max("s").over(before).alias("earlier"))
    found = starts.join(lasts, ["level", "part"]).select("level", F.coalesce(F.max("start").over(own), "earlier").alias("block_id"))
    return found.groupBy("level", "block_id").count().groupBy("level").agg(F.max("count").alias("largest"))


#: Thresholds that one scan of the entries decides.
LEVELS = 32


def adaptive_blocks(
    ids: DataFrame, grm: DataFrame, most: int = 1000, start: float = 0.006, step: float = 0.001
) -> tuple[DataFrame, float]:
    """Blocks (iid, block_id) of at most `most` people, and the threshold that gives them: the first of start, start + step, ... that does.
    Higher thresholds give smaller blocks, and past the largest entry each person is one, so LEVELS thresholds are looked at in one job, and others between two of them only
    where there are more. Entries that are not numbers raise."""
    entries = grm.select("i", "j", "k").checkpoint()
    row = entries.agg(F.max(F.abs("k")), F.count_if(F.isnan("k") | F.col("k").isNull())).first()
    if row[1]:
        raise ValueError(f"{row[1]} entries of the relatedness are not numbers")
    if most < 1:
        raise ValueError("a block has one person at least")
    at = lambda k: round(start + k * step, 9)
    low, high = 0, 0
    while at(high) <= (row[0] or 0.0):
        high += max(1, int(((row[0] or 0.0) - at(high)) / step))
    while low < high:
        tried = sorted({low + (high - 1 - low) * k // max(1, LEVELS - 1) for k in range(LEVELS)})
        largest = {r["level"]: r["largest"] for r in largest_blocks(ids, entries, [at(k) for k in tried]).collect()}
        good = [k for level, k in enumerate(tried) if (largest.get(level) or 0) <= most]
        bad = [k for level, k in enumerate(tried) if (largest.get(level) or 0) > most]
        low, high = (max(bad) + 1 if bad else low), (min(good) if good else high)
    return blocks(ids, entries, at(low)), at(low)


def inside(grm: DataFrame, block: DataFrame) -> tuple[DataFrame, int]:
    """The entries within blocks, weak ones too, and how many lie between blocks and are left out."""
    rows, columns = (block.select(F.col("iid").alias(c), F.col("block_id").alias(f"_{c}")) for c in "ij")
    placed = grm.join(rows, "i").join(columns, "j")
    return placed.filter("_i = _j").select("i", "j", "k"), placed.filter("_i <> _j").count()


def one_of_each(block: DataFrame, seed: int = 13) -> DataFrame:
    """iid of one member of each block."""
    return block.groupBy("block_id").agg(F.min(F.struct(chosen_order(F.col("iid"), seed).alias("o"), "iid")).alias("m")).select("m.iid")


def split_by_blocks(block: DataFrame, share: float = 0.8, seed: int = 1) -> DataFrame:
    """iid, split: no block straddles train and test. Blocks are taken in a fixed arithmetic order as long as each brings the running size
    nearer to the target, so train misses the target by half a block at most."""
    sizes = block.groupBy("block_id").count().withColumn("order", F.struct(chosen_order(F.col("block_id"), seed).alias("o"), "block_id"))
    target = F.lit(round(share * block.count()))
    summed = prefix_sums(sizes, "order", "count")
    nearer = F.abs(F.col("before") + F.col("count") - target) <= F.abs(F.col("before") - target)
    split = summed.select("block_id", F.when(nearer, "train").otherwise("test").alias("split"))
    return block.join(split, "block_id").select("iid", "split")


def filled(sizes: dict[int, int], target: int, seed: int) -> tuple[dict[int, int], int]:
    """How many blocks of each size to take, of so many, and their sum. Sizes come in an order that the seed decides, the first order being the falling one, and blocks
    of a size are taken as long as each brings the sum nearer to the target; it ends within 1 of it."""
    key = lambda c: -c if seed == 0 else (c * 7919 + seed * 104729) % 10007
    taken, total = dict.fromkeys(sizes, 0), 0
    for size in sorted(sizes, key=key):
        if abs(total - target) <= 1:
            break
        # a block brings the sum nearer as long as half of it fits
        taken[size] = max(0, min(sizes[size], (2 * (target - total) + size) // (2 * size)))
        total += taken[size] * size
    return taken, total


def best_split(block: DataFrame, share: float = 0.8, orders: int = 64, seed: int = 1) -> DataFrame:
    """iid, split: no block straddles train and test, and of several orders of the sizes the one that comes nearest to the target counts, the larger sum among equals.

    Of each size, the share of its blocks, rounded down, is train in every order, so that both sides have blocks of all sizes; the orders deal out the rest.
    Only the histogram of sizes reaches the driver; which blocks of a size are taken follows a fixed arithmetic order.
    """
    sizes = block.groupBy("block_id").count().checkpoint()
    histogram = {r["count"]: r["n"] for r in sizes.groupBy("count").agg(F.count("*").alias("n")).collect()}
    target = round(share * sum(c * n for c, n in histogram.items()))
    base = {c: math.floor(share * n) for c, n in histogram.items()}
    start = sum(c * n for c, n in base.items())
    rest = {c: n - base[c] for c, n in histogram.items()}
    found = [filled(rest, target - start, k) for k in range(orders)]
    taken, _ = min(found, key=lambda f: (abs(f[1] + start - target), -f[1]))
    ranked = sizes.select("block_id", "count", F.struct("count", chosen_order(F.col("block_id"), seed).alias("o"), "block_id").alias("_order"), F.lit(1).alias("_one"))
    placed = prefix_sums(ranked, "_order", "_one")
    # places run over all sizes: those of a size start where the smaller ones end
    quota, before = [], 0
    for size in sorted(histogram):
        quota.append((size, before + base[size] + taken[size]))
        before += histogram[size]
    cut = block.sparkSession.createDataFrame(quota or [(0, 0)], "count long, _until long")
    split = placed.join(cut, "count").select("block_id", F.when(F.col("before") < F.col("_until"), "train").otherwise("test").alias("split"))
    return block.join(split, "block_id").select("iid", "split")


def monomorphic(variants: DataFrame, genotype: DataFrame, observed: DataFrame, n_observed: int) -> DataFrame:
    """snp of variants whose dosage is the same in all observed rows; rows that are absent from the sparse layout are 0, so a variant
    without any row is constant."""
    seen = genotype.join(observed.select("iid"), "iid", "left_semi").groupBy("snp").agg(
        F.count("*").alias("n"), F.min("g").alias("low"), F.max("g").alias("high")
    )
    absent = F.col("n") < n_observed
    low = F.when(absent, F.least("low", F.lit(0.0))).otherwise(F.col("low"))
    high = F.when(absent, F.greatest("high", F.lit(0.0))).otherwise(F.col("high"))
    varied = seen.filter(low < high).select("snp")
    return variants.select("snp").distinct().join(varied, "snp", "left_anti")


#: Dosages that a repair gives to the people that it picks.
REPAIRED = (2.0, 1.0, 1.0, 1.0, 1.0, 2.0)


def repair_constant(genotype: DataFrame, constant: DataFrame, observed: DataFrame, start: Column | None = None, seed: int = 13) -> DataFrame:
    """snp, iid, g in which the constant variants (snp) have varied dosages: six observed people of each, who follow each other in a
    fixed arithmetic order from a place that the variant decides (`start`, its hash by default), get REPAIRED. Fewer observed people raise."""
    n = observed.count()
    if n < len(REPAIRED):
        raise ValueError(f"a repair needs {len(REPAIRED)} observed people")
    order = observed.select("iid", F.struct(chosen_order(F.col("iid"), seed).alias("o"), "iid").alias("_order"), F.lit(1).alias("_one"))
    people = prefix_sums(order, "_order", "_one").select("iid", F.col("before").cast("long").alias("_place"))
    first = F.xxhash64("snp") if start is None else start
    cells = F.array(*[F.struct(F.pmod(first + k, F.lit(n)).cast("long").alias("_place"), F.lit(g).alias("g")) for k, g in enumerate(REPAIRED)])
    patch = constant.select("snp", F.explode(cells).alias("_cell")).select("snp", "_cell.*").join(people, "_place").select("snp", "iid", "g")
    return genotype.select("snp", "iid", "g").join(patch, ["snp", "iid"], "left_anti").unionByName(patch)


def block_sizes(block: DataFrame) -> DataFrame:
    """blocks, people, largest."""
    return block.groupBy("block_id").count().agg(F.count("*").alias("blocks"), F.sum("count").alias("people"), F.max("count").alias("largest"))


def variant_chunks(variants: DataFrame, arrays: int, chunk: int = 200) -> DataFrame:
    """position (from 0), array, chunk: a table (snp, position) cut into intervals of equal width, closed on the right, the first one
    on both sides; the variants of each array are cut again into chunks. A single variant is in array 0."""
    last = max(1, variants.count() - 1)
    at = F.greatest(F.lit(0), F.ceil(F.col("position") * arrays / last) - 1)
    first = F.when(at > 0, F.floor(at * last / arrays) + 1).otherwise(0)
    return variants.select("snp", "position", at.alias("array"), F.floor((F.col("position") - first) / chunk).alias("chunk"))
