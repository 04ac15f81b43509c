"""Many responses of the same people in one fit: people and relatedness are dealt once, each family's matrix is decomposed once, and a response's
inverse covariance is a scaling of the eigenvectors by 1 / (tau lambda + sigma)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import families as fam
from .nullmodel import MEMBERS, _bucket, _by_bucket, collected_sum, prepared
from .scoretest import _flat, _lists, _type, added, dealt, finished, tile


@dataclass
class ManyModel:
    """names: the responses. members: w has a person's eigenvalue, and its row of the families' eigenvectors times covariates and residuals; f is the
    person's row of the eigenvectors. variances: tau and sigma, a row per response; arrays: as families.solve_sums, for each response."""

    names: list[str]
    members: DataFrame
    arrays: list[dict[str, np.ndarray]]
    variances: np.ndarray
    p: int
    n: int
    kind: str = "many"
    n_forms: int = 1

    @property
    def width(self) -> int:
        return len(self.names) * (self.p + 2)


def _moments(stacks: list[fam.Stack], x: np.ndarray, s: np.ndarray) -> np.ndarray:
    """n, trace and squares of K, x'x, x's, s's (its diagonal), then the same with K, without K's diagonal, in between."""
    trace = squares = 0.0
    p, r = x.shape[1], s.shape[1]
    xkx, xks, sks = np.zeros((p, p)), np.zeros((p, r)), np.zeros(r)
    for stack in stacks:
        k = stack.k.copy()
        diagonal = np.einsum("bii->bi", k)
        trace += float(diagonal.sum())
        diagonal[:] = 0
        squares += float((k**2).sum())
        xs, ss = x[stack.members], s[stack.members]
        ks = (k @ ss).reshape(-1, r)
        xkx += xs.reshape(-1, p).T @ (k @ xs).reshape(-1, p)
        xks += xs.reshape(-1, p).T @ ks
        sks += (ss.reshape(-1, r) * ks).sum(axis=0)
    return np.concatenate([np.ravel(v) for v in ([len(x), trace, squares], x.T @ x, x.T @ s, (s * s).sum(axis=0), xkx, xks, sks)])


def _solved(sums: np.ndarray, p: int, r: int, covariance: str, floor: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of the residuals (p x responses), and tau and sigma (responses x 2)."""
    n, trace, squares = sums[:3]
    parts = np.split(sums[3:], np.cumsum([p * p, p * r, r, p * p, p * r]))
    xx, xs, ss, xkx, xks, sks = parts
    xx, xs, xkx, xks = xx.reshape(p, p), xs.reshape(p, r), xkx.reshape(p, p), xks.reshape(p, r)
    a = np.linalg.solve(xx, xs)
    ee = ss - (a * xs).sum(axis=0)
    if covariance != "grm":
        return a, np.stack((np.zeros(r), ee / (n - (1 if covariance == "diag" else p))), axis=1)
    if not squares:
        raise ValueError("the relatedness matrix has no entries off its diagonal: use covariance='diag'")
    tau = (sks - 2 * (a * xks).sum(axis=0) + (a * (xkx @ a)).sum(axis=0)) / squares
    sigma = (ee - tau * trace) / n
    return a, np.stack((tau, sigma if floor is None else np.maximum(sigma, floor)), axis=1)


def _scales(values: np.ndarray, variances: np.ndarray) -> np.ndarray:
    """1 / (tau lambda + sigma), a column per response. Raises where a covariance isn't positive definite."""
    scale = values[:, None] * variances[:, 0] + variances[:, 1]
    if (scale <= 0).any():
        raise np.linalg.LinAlgError("a covariance is not positive definite")
    return 1 / scale


def fit_many(
    people: DataFrame, grm: DataFrame | None, xs: list[str], responses: list[str], covariance: str = "grm", floor: float | None = None, block: str | None = "family",
) -> ManyModel:
    """As nullmodel.fit_single for each of the responses, all of them known in all rows of people. The people's rows grow with the responses, so thousands are
    best fitted some hundred at a time."""
    if len(set(responses)) < len(responses) or not responses:
        raise ValueError("the responses need names of their own")
    ready = prepared(people, grm, xs, responses[0], None, block, covariance, responses[1:])
    p, r = ready.p, len(responses)
    others = [f"m{k}" for k in range(1, r)]

    def read(people_: pa.Table, entries: pa.Table | None) -> tuple[pa.Table, list[fam.Stack], np.ndarray, np.ndarray]:
        people_, stacks, z, _ = _bucket(people_, entries, p)
        return people_, stacks, z[:, :p], np.column_stack([z[:, p], *[people_.column(c).to_numpy() for c in others]])

    def sums(people_: pa.Table, entries: pa.Table | None) -> pa.Table:
        _, stacks, x, s = read(people_, entries)
        return pa.table({"sums": pa.array([_moments(stacks, x, s)], pa.list_(pa.float64()))})

    a, variances = _solved(collected_sum(_by_bucket(ready, sums, "sums array<double>"), "sums"), p, r, covariance, floor)

    def turned(people_: pa.Table, entries: pa.Table | None) -> pa.Table:
        people_, stacks, x, s = read(people_, entries)
        z = np.concatenate((x, s - x @ a), axis=1)
        out, vectors, total = np.zeros((len(x), 1 + p + r)), [], np.zeros((r, p, 1 + p))
        for stack in stacks:
            values, u = np.linalg.eigh(stack.k)
            vectors.append([u])
            uz = np.swapaxes(u, 1, 2) @ z[stack.members]
            out[stack.members] = np.concatenate((values[:, :, None], uz), axis=2)
            flat, scale = uz.reshape(-1, p + r), _scales(values.ravel(), variances)
            for k in range(r):
                total[k] += (flat[:, :p] * scale[:, k : k + 1]).T @ np.concatenate((flat[:, p + k : p + k + 1], flat[:, :p]), axis=1)
        bucket = people_.column("bucket").to_pylist()
        return pa.table({
            "iid": pa.array([*people_.column("iid").to_pylist(), None], pa.int64()), "bucket": pa.array([*bucket, bucket[0] if bucket else 0], pa.int32()),
            "block": pa.array([*people_.column("block").to_pylist(), None], pa.int64()), "w": pa.array([*list(out), total.ravel()], pa.list_(pa.float64())),
            "f": pa.concat_arrays([fam.flat_rows(stacks, vectors, len(x)), pa.array([[]], pa.list_(pa.float64()))]),
        })

    done = _by_bucket(ready, turned, MEMBERS).checkpoint()
    xw = collected_sum(done.filter("iid is null"), "w").reshape(r, p, 1 + p)
    return ManyModel(list(responses), done.filter("iid is not null"), [fam.solve_sums(m, p) for m in xw], variances, p, ready.n)


def sums_of_many(g: np.ndarray, people: pa.Table, variances: np.ndarray, p: int) -> np.ndarray:
    """For each variant and response g'Qe, g'Qx and g'Qg, as families.finish takes them. people: sorted by block, then id."""
    r = len(variances)
    w = np.stack(people.column("w").to_numpy()) if people.num_rows else np.zeros((0, 1 + p + r))
    out = np.zeros((len(g), r, p + 2))
    for members, vectors in fam.from_flat(people.column("block").to_numpy(), _flat(people, "f"), 1):
        own = np.ascontiguousarray(g[:, members].transpose(1, 0, 2)) @ vectors[0]
        turned, rows = own.transpose(1, 0, 2).reshape(len(g), -1), w[members].reshape(-1, w.shape[1])
        scale = _scales(rows[:, 0], variances)
        out[:, :, p + 1] += (turned * turned) @ scale
        for k in range(r):
            out[:, k, : p + 1] += (turned * scale[:, k]) @ np.concatenate((rows[:, 1 + p + k : 2 + p + k], rows[:, 1 : 1 + p]), axis=1)
    return out.reshape(len(g), -1)


def finish_many(sums: np.ndarray, model_arrays: list[dict[str, np.ndarray]], p: int) -> list[np.ndarray]:
    parts = sums.reshape(len(sums), len(model_arrays), p + 2)
    return [fam.finish(parts[:, k], arrays, p) for k, arrays in enumerate(model_arrays)]


def score_many(genotype: DataFrame, model: ManyModel, variants: int | None = None) -> DataFrame:
    """phenotype, and scoretest.RESULT, a row for each variant with a dosage in the model's people and each response. genotype: as for scoretest.score."""
    rows, people = dealt(genotype, model.members, variants)
    variances, p, arrays, names = model.variances, model.p, model.arrays, model.names
    width = model.width

    def work(dosages: pa.Table, members: pa.Table) -> pa.Table:
        if not dosages.num_rows:
            return pa.table({"snp": pa.array([], dosages.schema.field("snp").type), "sums": _lists(np.zeros((0, width)))})
        snp, g, members = tile(dosages, members)
        return pa.table({"snp": snp, "sums": _lists(sums_of_many(g, members, variances, p))})

    schema = T.StructType([T.StructField("snp", _type(genotype)), T.StructField("sums", T.ArrayType(T.DoubleType()))])
    parts = rows.groupBy("tile", "bucket").cogroup(people.groupBy("tile", "bucket")).applyInArrow(work, schema)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for name, done in zip(names, finish_many(added(batch.column(1)), arrays, p)):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(done)), batch.column(0), *[pa.array(c) for c in done.T]], ["phenotype", *out.names[1:]])

    out = T.StructType([T.StructField("phenotype", T.StringType()), T.StructField("snp", _type(genotype)), *[T.StructField(c, T.DoubleType()) for c in ("num", "info", "var")]])
    return finished(parts.groupBy("snp").agg(F.collect_list("sums").alias("sums")).mapInArrow(test, out), ("phenotype", "snp"))
