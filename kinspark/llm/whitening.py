"""Whitening of embeddings by shifted Cholesky QR.

Rows are centred and never stored: each pass reads the vectors again, divides them by the triangular factors found so far, and adds up
one small Gram matrix. The first pass shifts its diagonal, so that the Cholesky factor exists for any rows; the following ones make the columns
orthogonal to working precision. The product of the factors has the singular values of the centred rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, summed

#: Entries become whole numbers: floor(STEPS * c) + OFFSET.
STEPS, OFFSET = 64, 1_000_000
#: Components that are returned at most.
MOST_COMPONENTS = 32
#: Cholesky passes at most; columns are orthogonal enough when no entry of their Gram matrix is further from the identity than CLOSE.
MOST_PASSES, CLOSE = 8, 1e-13
#: Singular values below this share of the largest count as zero.
ZERO = 1e-10
#: Rows that a task multiplies at once.
RUN_ROWS = 4096


def whole(vectors: pa.Array, size: int) -> np.ndarray:
    """A row of whole numbers for each vector."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.floor(STEPS * flat) + OFFSET
    if len(x) and np.abs(x).max() >= 2**52:
        raise ValueError("an entry is too large to be cut into whole steps")
    return x.astype(np.int64).reshape(len(vectors), size)


def known(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v of the vectors that take part: not null, not empty, and without entries that are null or not finite."""
    entry = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), entry.alias("v")).filter("v IS NOT NULL AND size(v) > 0")
    return rows.filter(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))


def _summed(rows: DataFrame, size: int, work: Callable[[np.ndarray], np.ndarray], length: int, exact: bool = False) -> np.ndarray:
    """work's arrays for the rows' whole numbers, added up."""

    def runs(batch: pa.RecordBatch) -> np.ndarray:
        return sum(work(whole(batch.column(0).slice(at, RUN_ROWS), size)).ravel() for at in range(0, batch.num_rows, RUN_ROWS))

    return summed(rows.select("v"), runs, length, exact)


@dataclass
class Whitener:
    """n vectors with sums per dimension; directions: unit eigenvectors of the covariance as columns, by falling eigenvalue."""

    n: int
    sums: np.ndarray
    directions: np.ndarray
    values: np.ndarray
    passes: int

    @property
    def explained(self) -> np.ndarray:
        total = self.values.sum()
        return self.values / total if total else np.full(len(self.values), np.nan)

    @property
    def rank(self) -> int:
        return int((self.values > ZERO**2 * self.values[:1].max(initial=0)).sum())

    def scores(self, x: np.ndarray, most: int = MOST_COMPONENTS) -> np.ndarray:
        """Whitened rows; components without variance are NaN."""
        k = min(most, self.rank)
        out = np.full((len(x), min(most, len(self.values))), np.nan)
        out[:, :k] = centred(x, self.n, self.sums) @ (self.directions[:, :k] / np.sqrt(self.values[:k]))
        return out


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n, rounded once, as the difference is taken in whole numbers."""
    return (n * x - sums) / n


def over(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """rows divided from the right by upper triangular factors, in order."""
    for r in factors:
        out = np.empty_like(rows)
        for k in range(r.shape[1]):
            out[:, k] = (rows[:, k] - out[:, :k] @ r[:k, k]) / r[k, k]
        rows = out
    return rows


def fit(rows: DataFrame) -> Whitener | None:
    """rows: v, as `known` gives them; None if there are none. Vectors of unequal lengths raise."""
    first = rows.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    n, size = first[0], first[1]
    if not n:
        return None
    if first[1] != first[2]:
        raise ValueError(f"the vectors have {first[1]} to {first[2]} entries")
    sums = _summed(rows, size, lambda x: x.sum(axis=0), size, exact=True)
    if n * (np.abs(sums).max() + 1) >= 2**62:
        raise ValueError("the vectors' sums are too large for whole numbers")
    factors: list[np.ndarray] = []
    unit = np.finfo(float).eps
    for done in range(1, MOST_PASSES + 1):
        now = list(factors)

        def products(x: np.ndarray) -> np.ndarray:
            q = over(centred(x, n, sums), now)
            return q.T @ q

        gram = _summed(rows, size, products, size * size).reshape(size, size)
        trace = float(np.trace(gram))
        if trace == 0 or np.abs(gram - np.eye(size)).max() < CLOSE:
            break
        lowest = np.linalg.eigvalsh(gram)[0]
        # a shift of this size makes the factor exist, whatever the rows; it is left out once the columns are nearly orthogonal
        shift = 0.0 if factors and lowest > 0.01 else 11 * (size * n + size * (size + 1)) * unit * trace
        factors.append(np.linalg.cholesky(gram + shift * np.eye(size)).T)
    # with Q'Q = gram, exact for rows without full rank too: A'A = R' gram R, so A has the singular values of gram^(1/2) R
    spectrum, basis = np.linalg.eigh(gram)
    r = (np.sqrt(np.maximum(spectrum, 0))[:, None] * basis.T)
    for factor in reversed(factors):
        r = r @ factor
    _, singular, right = np.linalg.svd(r)
    return Whitener(n, sums, right.T, singular**2 / n, done)


def identity_error(rows: DataFrame, model: Whitener, most: int = MOST_COMPONENTS) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, among components with variance."""
    k = min(most, model.rank)
    if not k:
        return 0.0
    mean = _summed(rows, len(model.sums), lambda x: model.scores(x, k).sum(axis=0), k) / model.n

    def products(x: np.ndarray) -> np.ndarray:
        w = model.scores(x, k) - mean
        return w.T @ w

    covariance = _summed(rows, len(model.sums), products, k * k).reshape(k, k)
    return float(np.abs(covariance / model.n - np.eye(k)).max())


WHITENED = "vec_id long, deviation long, whitened array<double>"


def _deviation(x: np.ndarray, model: Whitener) -> list[int | None]:
    """Exact; null where it is too large for a long."""
    off = model.n * x - model.sums
    if len(off) and float(np.abs(off).max()) ** 2 * off.shape[1] >= 2**62:
        exact = [sum(v * v for v in row) for row in off.tolist()]
        return [v if v < 2**63 else None for v in exact]
    return (off * off).sum(axis=1).tolist()


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = MOST_COMPONENTS) -> tuple[DataFrame, Whitener | None]:
    """vec_id, deviation, whitened (an array of up to `most` components, null where a component has no variance) of each vector that takes
    part, and the model.

    Left out are vectors that are null or empty or hold entries that are null or not finite. Repeated rows count each; null ids stay; other
    columns aren't read. An empty table gives an empty one and no model. Vectors of unequal lengths, and entries beyond 2 ** 46,
    raise. Equal eigenvalues leave the choice of their components open.
    """
    prepare(vectors.sparkSession)
    rows = known(vectors, id_col, vector_col)
    model = fit(rows)
    if model is None:
        return vectors.sparkSession.createDataFrame([], WHITENED), None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(batch.column(1), len(model.sums))
            scores = model.scores(x, most)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(scores.ravel(), mask=np.isnan(scores.ravel())), scores.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_deviation(x, model), pa.int64()), lists], ["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(score, WHITENED), model


def whitened_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = MOST_COMPONENTS) -> DataFrame:
    """A row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error; as `whiten`."""
    found, model = whiten(vectors, id_col, vector_col, most)
    shares = [] if model is None else [None if np.isnan(v) else float(v) for v in model.explained[:most]]
    error = None if model is None else identity_error(known(vectors, id_col, vector_col), model, most)
    share = F.array(*[F.lit(v).cast("double") for v in shares]) if shares else F.array().cast("array<double>")
    each = found.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(None if model is None else model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(share, F.col("at") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
