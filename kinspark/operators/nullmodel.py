"""Null models: what a score test needs that does not depend on a variant.

People and the relatedness of their families are dealt to buckets of whole families. Tasks hold one bucket at a time and return sums of the
size of the covariates, or a row per person; the driver only solves systems of that size.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import families as fam

#: People of one bucket, about.
BUCKET_PEOPLE = 2000
#: Blocks of up to so many people have dense matrices in a task; larger ones are solved from their entries.
MOST_IN_BLOCK = 1000
MEMBERS = "iid long, bucket int, block long, w array<double>, f array<double>"


@dataclass
class NullModel:
    """kind: "single" or "joint". members: a row per person, with linear weights `w`, and in `f` the person's rows of the
    quadratic forms over the block. arrays: as families.solve_sums. related: False if all blocks are single people."""

    kind: str
    members: DataFrame
    arrays: dict[str, np.ndarray]
    variances: fam.Variances
    p: int
    n: int
    related: bool = True

    @property
    def n_forms(self) -> int:
        return 1 if self.kind == "single" else 3

    @property
    def width(self) -> int:
        """Sums of a variant: of all weights, and of the quadratic forms."""
        return 1 + self.p + (1 + 3 * self.p if self.kind == "joint" else 0) + self.n_forms

    @property
    def components(self) -> dict[str, float]:
        pairs = {"s": self.variances.s, "t": self.variances.t, "ts": self.variances.ts}
        return {f"{n}_{k}": v for k, pair in pairs.items() if pair for n, v in zip(("tau", "sigma"), pair)}


def sum_arrays(rows: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Arrays of equal length added up place by place: pos, total (and by)."""
    return rows.select(*(by or []), F.posexplode(column).alias("pos", "v")).groupBy(*(by or []), "pos").agg(F.sum("v").alias("total"))


def collected_sum(rows: DataFrame, column: str) -> np.ndarray:
    """The sum on the driver; for arrays of the size of the covariates."""
    return np.array([r["total"] for r in sum_arrays(rows, column).orderBy("pos").collect()])


@dataclass
class Prepared:
    people: DataFrame  # iid, bucket, block, x0.., s, t
    entries: DataFrame | None  # i, j, k, bucket
    p: int
    n: int


def prepared(
    people: DataFrame, grm: DataFrame | None, xs: list[str], surrogate: str, target: str | None, block: str | None, covariance: str, more: list[str] = (),
) -> Prepared:
    """People and entries dealt to buckets. Covariates are centred; the intercept is x0. Raises on missing covariates or
    surrogates, on repeated ids, and on entries between blocks. more: further responses, which become m1, m2, ..."""
    if covariance == "grm" and grm is None:
        raise ValueError("covariance='grm' needs a relatedness matrix")
    if covariance == "grm" and block is None:
        from .blocks import blocks

        people = people.join(blocks(people.select("iid"), grm).withColumnRenamed("block_id", "_block"), "iid")
        block = "_block"
    own = F.col(block) if covariance == "grm" else F.col("iid")
    known = F.lit(None).cast("double") if target is None else F.col(target).cast("double")
    rows = people.select(
        F.col("iid").cast("long"), own.cast("long").alias("block"), *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(xs, 1)],
        F.col(surrogate).cast("double").alias("s"), F.when(~F.isnan(known), known).alias("t"),
        *[F.col(c).cast("double").alias(f"m{k}") for k, c in enumerate(more, 1)],
    ).checkpoint()
    others = [f"m{k}" for k in range(1, len(more) + 1)]
    needed = [f"x{k}" for k in range(1, len(xs) + 1)] + ["s"]
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(c) for c in [*needed, *others]])
    row = rows.agg(F.count("*"), F.count_if(bad), F.countDistinct("iid"), *[F.avg(c) for c in needed[:-1]]).first()
    n = row[0]
    if row[1] or row[2] != n or not n:
        raise ValueError(f"{row[1]} of {n} people miss a covariate or the response; {row[2]} ids are distinct")
    buckets = max(1, -(-n // BUCKET_PEOPLE))
    bucket = F.pmod(F.xxhash64("block"), F.lit(buckets)).cast("int")
    centred = [(F.col(c) - F.lit(m)).alias(c) for c, m in zip(needed, row[3:])]
    dealt = rows.select("iid", bucket.alias("bucket"), "block", F.lit(1.0).alias("x0"), *centred, "s", "t", *others)
    if covariance != "grm":
        return Prepared(dealt, None, len(xs) + 1, n)
    left, right = (dealt.select(F.col("iid").alias(i), F.col("block").alias(f"block_{i}"), "bucket") for i in "ij")
    entries = grm.select(F.col("i").cast("long"), F.col("j").cast("long"), F.col("k").cast("double")).join(left, "i").join(right.drop("bucket"), "j")
    # an alias of its own, as both sides of a cogroup come from one table
    entries = entries.select("i", "j", "k", F.col("bucket").alias("bucket"), (F.col("block_i") != F.col("block_j")).alias("crosses")).checkpoint()
    return Prepared(dealt, entries, len(xs) + 1, n)


def _columns(table: pa.Table, names: list[str]) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in names]


def _bucket(people: pa.Table, entries: pa.Table | None, p: int, most: int | None = None) -> tuple[pa.Table, list[fam.Stack | fam.Sparse], np.ndarray, np.ndarray]:
    """People sorted by block and id, the stacks, z (x, s, t) and who has a target. Blocks of more than `most` people are sparse; without it, of more than
    MOST_IN_BLOCK they raise."""
    people = people.sort_by([("block", "ascending"), ("iid", "ascending")])
    iid, block, t = _columns(people, ["iid", "block", "t"])
    largest = int(fam.runs(block)[1].max(initial=0))
    if most is None and largest > MOST_IN_BLOCK:
        raise ValueError(f"a block has {largest} people; find blocks with blocks.adaptive_blocks, which has {MOST_IN_BLOCK} at most")
    related = None
    if entries is not None:
        if entries.num_rows and any(entries.column("crosses").to_pylist()):
            raise ValueError("the relatedness matrix has entries between blocks: drop them, or pass block=None to have blocks found")
        related = tuple(_columns(entries, ["i", "j", "k"]))
    seen = ~np.isnan(t.astype(float))
    z = np.column_stack([*_columns(people, [f"x{k}" for k in range(p)] + ["s"]), np.where(seen, t, 0.0)]).astype(float)
    return people, fam.stacks(iid, block, related, most), z, seen


def _by_bucket(ready: Prepared, work, schema: str) -> DataFrame:  # noqa: ANN001
    """work(people, entries or None) -> table, for each bucket."""
    if ready.entries is None:
        return ready.people.groupBy("bucket").applyInArrow(lambda people: work(people, None), schema)
    return ready.people.groupBy("bucket").cogroup(ready.entries.groupBy("bucket")).applyInArrow(work, schema)


def _native_moments(ready: Prepared) -> tuple[fam.Moments, fam.Moments]:
    """Of unrelated people, by one aggregation."""
    z = [*[F.col(f"x{k}") for k in range(ready.p)], F.col("s"), F.coalesce("t", F.lit(0.0))]
    pairs = [(a, b) for a in range(len(z)) for b in range(a + 1)]
    seen = F.col("t").isNotNull()
    sums = [F.coalesce(F.sum(v), F.lit(0.0)) for a, b in pairs for v in (z[a] * z[b], F.when(seen, z[a] * z[b]))]
    row = ready.people.agg(F.count_if(seen), *sums).first()
    found = []
    for n, values in ((ready.n, row[1::2]), (row[0], row[2::2])):
        zz = np.zeros((len(z), len(z)))
        for (a, b), v in zip(pairs, values):
            zz[a, b] = zz[b, a] = v
        found.append(fam.Moments(n, n, 0.0, zz, np.zeros_like(zz)))
    return tuple(found)


def gathered(ready: Prepared) -> tuple[fam.Moments, fam.Moments]:
    """Moments of all people, and of those with a target."""
    p, most = ready.p, MOST_IN_BLOCK
    if ready.entries is None:
        return _native_moments(ready)

    def sums(people: pa.Table, entries: pa.Table | None) -> pa.Table:
        _, stacks, z, seen = _bucket(people, entries, p, most)
        return pa.table({"sums": pa.array([fam.moment_sums(stacks, z, seen)], pa.list_(pa.float64()))})

    return fam.Moments.of(collected_sum(_by_bucket(ready, sums, "sums array<double>"), "sums"), p + 2)


def _unrelated_model(kind: str, ready: Prepared, every: fam.Moments, seen: fam.Moments, variances: fam.Variances, turn: np.ndarray) -> NullModel:
    """The forms are numbers, so weights are sums of columns, and their sums follow from the moments."""
    p = ready.p
    own = variances.s[1]
    if own <= 0:
        raise np.linalg.LinAlgError("a covariance is not positive definite")
    x = [F.col(f"x{k}") for k in range(p)]
    weigh = lambda e: sum((F.col(c) * float(v) for c, v in zip([*[f"x{k}" for k in range(p)], "s", "t"], e) if v), F.lit(0.0))
    e_s = weigh(turn[:, 0])
    w, f = [e_s / own, *[c / own for c in x]], [F.lit(1 / own)]
    xw = [every.zz[:p] @ turn[:, 0] / own, *(every.zz[:p, :p] / own).T]
    if kind == "joint":
        cross = variances.ts[1] / own
        left = variances.t[1] - variances.ts[1] * cross
        if left <= 0:
            raise np.linalg.LinAlgError("a covariance is not positive definite")
        v, h = 1 / left, cross / left
        known = lambda c: F.when(F.col("t").isNotNull(), c).otherwise(0.0)
        w += [known(weigh(turn[:, 1]) * v - e_s * h), *[known(c * v) for c in x], *[known(c * h) for c in x] * 2]
        f += [known(F.lit(v)), known(F.lit(h))]
        xx = seen.zz[:p, :p]
        xw += [seen.zz[:p] @ (turn[:, 1] * v - turn[:, 0] * h), *(xx * v).T, *(xx * h).T, *(xx * h).T]
    members = ready.people.select("iid", "bucket", "block", F.array(*w).alias("w"), F.array(*f).alias("f"))
    return NullModel(kind, members, fam.solve_sums(np.stack(xw, axis=1), p), variances, p, ready.n, related=False)


def _model(kind: str, ready: Prepared, variances: fam.Variances, turn: np.ndarray) -> NullModel:
    """turn: weights of z's columns that give the residual of s, and of t (columns)."""
    p, most = ready.p, MOST_IN_BLOCK

    def work(people: pa.Table, entries: pa.Table | None) -> pa.Table:
        people, stacks, z, seen = _bucket(people, entries, p, most)
        e = z @ turn
        e[~seen, 1:] = 0
        z = np.concatenate((z[:, :p], e), axis=1)
        w, parts = fam.weights(stacks, z, seen, variances, p)
        n, rows = len(z), fam.flat_rows(stacks, parts, len(z))
        # One more row, without an id, has the bucket's sums of x'w.
        total = (z[:, :p].T @ w).ravel()
        bucket = people.column("bucket").to_pylist()
        return pa.table({
            "iid": pa.array([*people.column("iid").to_pylist(), None], pa.int64()),
            "bucket": pa.array([*bucket, bucket[0] if bucket else 0], pa.int32()),
            "block": pa.array([*people.column("block").to_pylist(), None], pa.int64()),
            "w": pa.array([*list(w), total], pa.list_(pa.float64())),
            "f": pa.concat_arrays([rows, pa.array([[]] if n else [None], pa.list_(pa.float64()))]),
        })

    done = _by_bucket(ready, work, MEMBERS).checkpoint()
    xw = collected_sum(done.filter("iid is null"), "w").reshape(p, -1)
    return NullModel(kind, done.filter("iid is not null"), fam.solve_sums(xw, p), variances, p, ready.n)


def fit_single(
    people: DataFrame, grm: DataFrame | None, xs: list[str], response: str, covariance: str = "grm", floor: float | None = None, block: str | None = "family",
) -> NullModel:
    """One response, known in all rows of people (iid, block, xs, response). covariance: "grm", "diag" (variance over n - 1) or
    "ols" (over n - p). block: the column of the family; None to have blocks found in the matrix."""
    ready = prepared(people, grm, xs, response, None, block, covariance)
    every, seen = gathered(ready)
    p = ready.p
    e = fam.residual(every.zz, p, p)
    if covariance == "grm":
        s = every.pair(e, e, floor)
    else:
        s = (0.0, float(e @ every.zz @ e) / (ready.n - (1 if covariance == "diag" else p)))
    turn = np.zeros((p + 2, 1))
    turn[:, 0] = e
    if covariance != "grm":
        return _unrelated_model("single", ready, every, seen, fam.Variances(s), turn)
    return _model("single", ready, fam.Variances(s), turn)


def joint_variances(every: fam.Moments, seen: fam.Moments, e_s: np.ndarray, e_t: np.ndarray, covariance: str, floor: float | None) -> fam.Variances:
    if covariance == "grm":
        return fam.Variances(every.pair(e_s, e_s), seen.pair(e_t, e_t, floor), seen.pair(e_s, e_t))
    # residuals have mean 0 among those that they were fitted on, so the covariance needs no centring of the other side
    return fam.Variances(
        (0.0, float(e_s @ every.zz @ e_s) / (every.n - 1)), (0.0, float(e_t @ seen.zz @ e_t) / (seen.n - 1)), (0.0, float(e_s @ seen.zz @ e_t) / (seen.n - 1)),
    )


def fit_joint(
    people: DataFrame, grm: DataFrame | None, xs: list[str], floor: float | None = 0.01, block: str | None = "family", covariance: str = "grm",
    target: str = "y_obs", surrogate: str = "s",
) -> NullModel:
    """Target, null where unknown, and complete surrogate. Covariances between the two are aligned by id. covariance: "grm" or "diag"."""
    ready = prepared(people, grm, xs, surrogate, target, block, covariance)
    every, seen = gathered(ready)
    p = ready.p
    e_s, e_t = fam.residual(every.zz, p, p), fam.residual(seen.zz, p, p + 1)
    variances, turn = joint_variances(every, seen, e_s, e_t, covariance, floor), np.stack((e_s, e_t), axis=1)
    if covariance != "grm":
        return _unrelated_model("joint", ready, every, seen, variances, turn)
    return _model("joint", ready, variances, turn)
