"""The joint test with a null model for each variant: the variant takes part in the surrogate's regression, so variances, and with them
all inverses, are the variant's own.

A family that has a target for all of its people, or for none, has all its matrices in the eigenvectors of its relatedness: they are found once, and a
variant's inverses are numbers over the eigenvalues. The inverses of other families are those of few distinct matrices and patterns of who is known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import families as fam
from .nullmodel import MEMBERS, Prepared, _bucket, _by_bucket, gathered, prepared
from .scoretest import _flat, _lists, _schema, added, dealt, finished, tile


def _base(ready: Prepared) -> DataFrame:
    """A row per person: w has covariates, surrogate, target (0 where unknown) and whether it is known; f the row of the relatedness."""
    p = ready.p

    def work(people: pa.Table, entries: pa.Table | None) -> pa.Table:
        people, stacks, z, seen = _bucket(people, entries, p)
        rows = np.concatenate((z, seen[:, None]), axis=1)
        return pa.table({
            "iid": people.column("iid"), "bucket": people.column("bucket"), "block": people.column("block"), "w": _lists(rows),
            "f": fam.flat_rows(stacks, [[s.k] for s in stacks], len(z)),
        })

    return _by_bucket(ready, work, MEMBERS).checkpoint()


def _read(members: pa.Table) -> tuple[np.ndarray, np.ndarray, list[fam.Stack]]:
    w = np.stack(members.column("w").to_numpy())
    found = fam.from_flat(members.column("block").to_numpy(), _flat(members, "f"), 1)
    return w[:, :-1], w[:, -1] > 0, [fam.Stack(m, forms[0]) for m, forms in found]


def _variant_moments(g: np.ndarray, z: np.ndarray, seen: np.ndarray, found: list[fam.Stack]) -> np.ndarray:
    """For each variant g'z, g'g, g'Kz and g'Kg, of all, then g'z and g'Kz of those with a target. K is without its diagonal."""
    out = []
    for gs, zs in ((g, z), (g * seen, z * seen[:, None])):
        kz, kg = np.zeros((len(g), z.shape[1])), np.zeros((len(g), 1))
        for s in found:
            k = s.k * (1 - np.eye(s.k.shape[-1]))
            kz += gs[:, s.members].reshape(len(g), -1) @ (k @ zs[s.members]).reshape(-1, z.shape[1])
            kg[:, 0] += fam.quadratic(gs, s.members, k)
        out += [gs @ zs, (gs * gs).sum(axis=1)[:, None], kz, kg]
    return np.concatenate(out, axis=1)


def _bordered(square: np.ndarray, edge: np.ndarray, corner: float) -> np.ndarray:
    return np.block([[square, edge[:, None]], [edge[None, :], np.array([[corner]])]])


def _variances(sums: np.ndarray, every: fam.Moments, seen: fam.Moments, p: int, floor: float | None) -> np.ndarray:
    """tau and sigma of surrogate, target and between them, a row per variant."""
    c = p + 2
    e_t = np.append(fam.residual(seen.zz, p, p + 1), 0.0)
    own = lambda row, at: (row[at : at + c], row[at + c], row[at + c + 1 : at + 2 * c + 1], row[at + 2 * c + 1])
    out = []
    for row in sums:
        (gz, gg, gkz, gkg), (oz, og, okz, okg) = own(row, 0), own(row, 2 * c + 2)
        all_ = fam.Moments(every.n, every.trace, every.squares, _bordered(every.zz, gz, gg), _bordered(every.zkz, gkz, gkg))
        obs = fam.Moments(seen.n, seen.trace, seen.squares, _bordered(seen.zz, oz, og), _bordered(seen.zkz, okz, okg))
        regressors = [*range(p), c]
        e_s = np.zeros(c + 1)
        # a variant that the covariates explain has no coefficient of its own
        e_s[regressors] = -np.linalg.lstsq(all_.zz[np.ix_(regressors, regressors)], all_.zz[regressors, p], rcond=None)[0]
        e_s[p] = 1
        out.append([*all_.pair(e_s, e_s), *obs.pair(e_t, e_t, floor), *obs.pair(e_s, e_t)])
    return np.array(out).reshape(-1, 6)


def _scales(values: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
    """Forms of families with all or no targets over their eigenvalues: variants x eigenvalues."""
    lines = [v[:, k : k + 1] * values + v[:, k + 1 : k + 2] for k in (0, 2, 4)]
    if (lines[0] <= 0).any():
        raise np.linalg.LinAlgError("a covariance is not positive definite")
    q = 1 / lines[0]
    left = lines[1] - lines[2] ** 2 * q
    return [q, left, lines[2] * q]


def own_sums(g: np.ndarray, z: np.ndarray, seen: np.ndarray, found: list[fam.Stack], variances: np.ndarray, p: int) -> np.ndarray:
    """For each variant (rows of g and variances) the sums of x'w and g'w for the weights' columns of families.weights, then g'Fg for the three
    forms, all by the variant's variances. z: covariates, residuals of surrogate and target."""
    k = 2 + 4 * p
    xw, gw, gg = np.zeros((len(g), p, k)), np.zeros((len(g), k)), np.zeros((len(g), 3))
    for stack in found:
        known = seen[stack.members]
        mixed = known.any(axis=1) & ~known.all(axis=1)
        for targets in (True, False):
            own = np.flatnonzero(~mixed & (known[:, 0] == targets))
            if not len(own):
                continue
            members = stack.members[own]
            values, u = np.linalg.eigh(stack.k[own])
            zu = (np.swapaxes(u, 1, 2) @ z[members]).reshape(-1, p + 2)
            gu = (np.ascontiguousarray(g[:, members].transpose(1, 0, 2)) @ u).transpose(1, 0, 2).reshape(len(g), -1)
            q, left, slope = _scales(values.ravel(), variances)
            if targets and (left <= 0).any():
                raise np.linalg.LinAlgError("a covariance is not positive definite")
            x, s, t = zu[:, :p], zu[:, p : p + 1], zu[:, p + 1 :]
            v = 1 / left if targets else np.zeros_like(q)
            h = v * slope if targets else v
            # a form's products with x and with g of the columns that it turns
            for form, columns, at in ((q, np.concatenate((s, x), axis=1), [0, *range(1, 1 + p)]), (v, np.concatenate((t, x), axis=1), [1 + p, *range(2 + p, 2 + 2 * p)])):
                gw[:, at] += (gu * form) @ columns
                xw[:, :, at] += (form @ (x[:, :, None] * columns[:, None, :]).reshape(len(x), -1)).reshape(len(g), p, -1)
            if targets:
                gh, xh = (gu * h) @ np.concatenate((s, x), axis=1), (h @ (x[:, :, None] * zu[:, None, : p + 1]).reshape(len(x), -1)).reshape(len(g), p, p + 1)
                gw[:, 1 + p] -= gh[:, 0]
                xw[:, :, 1 + p] -= xh[:, :, p]
                for at in (2 + 2 * p, 2 + 3 * p):
                    gw[:, at : at + p] += gh[:, 1:]
                    xw[:, :, at : at + p] += xh[:, :, :p]
            gg += np.stack([(gu * gu * form).sum(axis=1) for form in (q, v, h)], axis=1)
        at = np.flatnonzero(mixed)
        if not len(at):
            continue
        size = known.shape[1]
        patterns = np.concatenate((stack.k[at].reshape(len(at), -1), known[at]), axis=1)
        distinct, which = np.unique(patterns, axis=0, return_inverse=True)
        tau = lambda c: (variances[:, c, None, None], variances[:, c + 1, None, None])
        for d, pattern in enumerate(distinct):
            members = stack.members[at[which.ravel() == d]]
            q, v, h = fam.forms(pattern[: size * size].reshape(size, size), pattern[None, size * size :] > 0, fam.Variances(tau(0), tau(2), tau(4)))
            own, rows = g[:, members], z[members]
            x, s, t = rows[:, :, :p], rows[:, :, p : p + 1], rows[:, :, p + 1 :]
            turn = lambda form, columns: np.einsum("mij,bjc->mbic", form, columns)
            w = np.concatenate([turn(q, s), turn(q, x), turn(v, t) - turn(h, s), turn(v, x), turn(h, x), turn(np.swapaxes(h, 1, 2), x)], axis=3)
            gw += np.einsum("mbi,mbic->mc", own, w)
            xw += np.einsum("bia,mbic->mac", x, w)
            gg += np.stack([np.einsum("mbi,mij,mbj->m", own, form, own) for form in (q, v, h)], axis=1)
    return np.concatenate((xw.reshape(len(g), -1), gw, gg), axis=1)


def score_each(
    genotype: DataFrame, people: DataFrame, grm: DataFrame, xs: list[str], floor: float | None = None, block: str | None = "family",
    target: str = "y_obs", surrogate: str = "s", variants: int | None = None,
) -> DataFrame:
    """scoretest.RESULT for variants that have a dosage in people; arguments as for nullmodel.fit_joint and scoretest.score."""
    ready = prepared(people, grm, xs, surrogate, target, block, "grm")
    every, seen_ = gathered(ready)
    p = ready.p
    e_s, e_t = fam.residual(every.zz, p, p), fam.residual(seen_.zz, p, p + 1)
    turn = np.stack((e_s, e_t), axis=1)
    genotype = genotype.select("snp", "iid", "g").checkpoint()
    rows, members = dealt(genotype, _base(ready), variants)
    snp_type = genotype.schema["snp"].dataType

    def first(dosages: pa.Table, people_: pa.Table) -> pa.Table:
        if not dosages.num_rows:
            return pa.table({"snp": pa.array([], dosages.schema.field("snp").type), "tile": pa.array([], pa.int32()), "sums": _lists(np.zeros((0, 1)))})
        snp, g, people_ = tile(dosages, people_)
        at = dosages.column("tile")[0].as_py()
        z, seen, found = _read(people_)
        return pa.table({"snp": snp, "tile": pa.array([at] * len(snp), pa.int32()), "sums": _lists(_variant_moments(g, z, seen, found))})

    sums = T.ArrayType(T.DoubleType())
    placed = T.StructType([T.StructField("snp", snp_type), T.StructField("tile", T.IntegerType()), T.StructField("sums", sums)])
    parts = rows.groupBy("tile", "bucket").cogroup(members.groupBy("tile", "bucket")).applyInArrow(first, placed)

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _variances(added(batch.column(2)), every, seen_, p, floor) if batch.num_rows else np.zeros((0, 6))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(found)], ["snp", "tile", "sums"])

    own = parts.groupBy("snp", "tile").agg(F.collect_list("sums").alias("sums")).mapInArrow(solved, placed).checkpoint()
    buckets = members.select(F.col("bucket").alias("b")).distinct()  # a row for some thousands of people
    # Each tile needs each of its variants, also those without a dosage there: a row without an id has the variances.
    marks = own.crossJoin(F.broadcast(buckets)).select("tile", F.col("b").alias("bucket"), "snp", F.lit(None).cast("long").alias("iid"), F.lit(None).cast("double").alias("g"), "sums")
    both = rows.withColumn("sums", F.lit(None).cast(sums)).unionByName(marks)
    again = _base_copy(members)

    def second(dosages: pa.Table, people_: pa.Table) -> pa.Table:
        if not dosages.num_rows or not people_.num_rows:
            return pa.table({"snp": pa.array([], dosages.schema.field("snp").type), "sums": _lists(np.zeros((0, 1)))})
        given = dosages.filter(pc.is_null(dosages.column("iid")))
        variances = dict(zip(given.column("snp").to_pylist(), given.column("sums").to_pylist()))
        snp, g, people_ = tile(dosages.filter(pc.is_valid(dosages.column("iid"))), people_)
        places = {s: at for at, s in enumerate(snp.to_pylist())}
        z, seen, found = _read(people_)
        e = z @ turn
        e[~seen, 1:] = 0
        z = np.concatenate((z[:, :p], e), axis=1)
        every_g = np.zeros((len(variances), len(z)))
        for row, name in enumerate(variances):
            if name in places:
                every_g[row] = g[places[name]]
        out = own_sums(every_g, z, seen, found, np.array(list(variances.values())), p)
        return pa.table({"snp": pa.array(list(variances), dosages.schema.field("snp").type), "sums": _lists(out)})

    schema = T.StructType([T.StructField("snp", snp_type), T.StructField("sums", sums)])
    tested = both.groupBy("tile", "bucket").cogroup(again.groupBy("tile", "bucket")).applyInArrow(second, schema)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 2 + 4 * p
        for batch in batches:
            done = np.zeros((0, 3))
            if batch.num_rows:
                total = added(batch.column(1))
                done = fam.finish(total[:, p * k :], fam.solve_sums(total[:, : p * k].reshape(-1, p, k), p), p)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in done.T]], ["snp", "num", "info", "var"])

    return finished(tested.groupBy("snp").agg(F.collect_list("sums").alias("sums")).mapInArrow(test, _schema(genotype, "num", "info", "var")))


def _base_copy(members: DataFrame) -> DataFrame:
    """The same rows under new column references, for a second cogroup with rows that descend from them."""
    return members.select(*[F.col(c).alias(c) for c in members.columns])
