"""Nearest neighbours by multiprobe p-stable hashing.

Each table hashes a vector by the cells of some random projections. A query visits cells in the order of the estimated probability that a
neighbour at a typical distance lies there, until that probability adds up to what the tables need for the wanted recall. Vectors and queries meet in keys of some
thousand rows; a task computes exact distances within the visited cells and keeps the nearest of each query.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored, summed

K = 10
TABLES = 3
#: Recall that the visited cells are chosen for, by the estimate.
RECALL = 0.96
#: Width of a cell, in standard deviations of a projection, and vectors of a table's cell on average.
WIDTH, CELL_ROWS = 2.5, 50
#: The neighbours' distance is measured for so many vectors at most, those with the smallest hash of their id, against all vectors. The distance is this
#: quantile of those to their K-th neighbours.
SAMPLE_ROWS, QUANTILE = 256, 0.9
#: A query that would visit more cells of a table is compared with all vectors.
MOST_PROBES = 4096
#: Rows of a key, of a block of a key with more rows, and queries of a key's block, about.
KEY_ROWS, BLOCK_ROWS, QUERY_ROWS = 4096, 8192, 1024
#: Cells of a projection that are looked at on either side of the query's, and the least probability of one.
REACH, LEAST = 3, 1e-4
_PHI = np.vectorize(lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2))), otypes=[float])


def matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))


def known(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v of vectors that take part: with an id, not null, empty or zero, and without entries that are null or not finite."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter("id IS NOT NULL AND size(v) > 0")
    rows = rows.filter(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    return rows.filter(F.exists("v", lambda c: c != 0))


def nearest_of(rows: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the k nearest rows with other ids, nearest first, then by id; an id that repeats counts once."""
    score = np.sqrt(((rows - query) ** 2).sum(axis=1))
    keep = ids != own
    score, ids = score[keep], ids[keep]
    order = np.lexsort((ids, score)) if len(ids) <= 4 * k else None
    if order is None:
        near = np.flatnonzero(score <= np.partition(score, 4 * k - 1)[4 * k - 1])
        order = near[np.lexsort((ids[near], score[near]))]
        if len(np.unique(ids[order])) < k:
            order = np.lexsort((ids, score))
    first = np.sort(np.unique(ids[order], return_index=True)[1])[:k]
    return ids[order][first], score[order][first]


@dataclass
class Hashing:
    """Tables of projections (tables x entries x functions) with offsets, fitted to the vectors' mean, spread and the neighbours' distance."""

    mean: np.ndarray
    spread: float
    radius: float
    directions: np.ndarray
    offsets: np.ndarray
    mixers: np.ndarray

    @property
    def width(self) -> float:
        return WIDTH * self.spread

    def projected(self, rows: np.ndarray) -> np.ndarray:
        """Rows x tables x functions."""
        return np.einsum("nd,tdf->ntf", rows - self.mean, self.directions, optimize=True)

    def hashed(self, places: np.ndarray, table: int) -> np.ndarray:
        """One number for each row of places along the projections of a table."""
        with np.errstate(over="ignore"):
            x = (places.astype(np.int64).astype(np.uint64) * self.mixers[table]).sum(axis=-1, dtype=np.uint64)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            return (x ^ (x >> np.uint64(29))).view(np.int64)

    def cells(self, rows: np.ndarray) -> np.ndarray:
        """Rows x tables."""
        places = np.floor((self.projected(rows) + self.offsets) / self.width)
        return np.stack([self.hashed(places[:, t], t) for t in range(len(self.directions))], axis=1)

    def probes(self, query: np.ndarray) -> np.ndarray | None:
        """Cells of all tables that a query visits; None if there are more than MOST_PROBES in a table."""
        wanted = 1 - (1 - RECALL) ** (1 / len(self.directions))
        norm, r = float(np.linalg.norm(query - self.mean)), self.radius
        # of a neighbour at distance r that is as far from the mean as the query: where its projection lies given the query's, and how widely
        pull = max(0.0, 1 - r * r / (2 * norm * norm)) if norm else 0.0
        deviation = math.sqrt(max(r * r - ((1 - pull) * norm) ** 2, 1e-18 * self.spread**2, 1e-300))
        found = []
        for t, own in enumerate(self.projected(query[None])[0]):
            at = pull * own + self.offsets[t]
            places = np.floor((own + self.offsets[t]) / self.width)[:, None] + np.arange(-REACH, REACH + 1)
            chance = _PHI((self.width * (places + 1) - at[:, None]) / deviation) - _PHI((self.width * places - at[:, None]) / deviation)
            visited = best_first(chance, wanted)
            if visited is None:
                return None
            found.append(self.hashed(np.take_along_axis(places, visited.T, axis=1).T, t))
        return np.unique(np.concatenate(found))


def best_first(chance: np.ndarray, wanted: float) -> np.ndarray | None:
    """Perturbations by falling product of chance (functions x places), until their sum is `wanted` or none above LEAST are left: rows of places. None if
    it takes more than MOST_PROBES."""
    order = np.argsort(-chance, axis=1, kind="stable")
    costs = []
    for row in -np.sort(-chance, axis=1):
        kept = [-math.log(p) for p in row if p > LEAST] or [-math.log(max(row[0], 1e-300))]
        costs.append(kept)
    # functions whose second place costs least come last, so that a set is reached by one path: its last raised function only goes up
    by = sorted(range(len(costs)), key=lambda i: costs[i][1] - costs[i][0] if len(costs[i]) > 1 else math.inf)
    heap = [(sum(c[0] for c in costs), 0, (0,) * len(costs))]
    found, total = [], 0.0
    while heap and total < wanted:
        cost, last, state = heapq.heappop(heap)
        found.append(state)
        total += math.exp(-cost)
        if len(found) > MOST_PROBES:
            return None
        for j in range(last, len(by)):
            own, level = costs[by[j]], state[j]
            if level + 1 < len(own):
                heapq.heappush(heap, (cost + own[level + 1] - own[level], j, (*state[:j], level + 1, *state[j + 1 :])))
    levels = np.array(found)
    out = np.empty_like(levels)
    for j, i in enumerate(by):
        out[:, i] = order[i, levels[:, j]]
    return out


def _sizes(rows: DataFrame) -> tuple[int, int]:
    first = rows.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if first[1] != first[2]:
        raise ValueError(f"the vectors have {first[1]} to {first[2]} entries")
    return first[0], first[1] or 0


def typical_distance(rows: DataFrame, size: int, k: int = K) -> float:
    """The QUANTILE of the distances from a bounded sample to their k-th neighbours among all rows; 0 without neighbours."""
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("id", "v").toArrow()
    own, queries = sample.column("id").to_numpy(), matrix(sample.column("v").combine_chunks())

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(own), k), np.inf)
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), matrix(batch.column(1))
            for q in range(len(own)):
                d = ((x - queries[q]) ** 2).sum(axis=1)
                both = np.concatenate((best[q], np.where(ids == own[q], np.inf, d)))
                best[q] = np.partition(both, k - 1)[:k]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(own)), k)), pa.array(best.ravel())], ["q", "d"])

    each = rows.select("id", "v").mapInArrow(near, "q long, d double").filter("d < double('infinity')")
    last = each.groupBy("q").agg(F.element_at(F.slice(F.sort_array(F.collect_list("d")), 1, k), -1).alias("d"))
    found = last.agg(F.percentile("d", F.lit(QUANTILE))).first()[0]
    return math.sqrt(found or 0.0)


def fit(rows: DataFrame, tables: int = TABLES, k: int = K, seed: int = 7) -> tuple[Hashing | None, int]:
    """The hashing and the number of rows (id, v). Sums are taken over all rows; only the distance rests on a sample."""
    n, size = _sizes(rows)
    if not n:
        return None, 0

    def sums(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch.column(0))
        return np.append(x.sum(axis=0), (x * x).sum())

    total = summed(rows.select("v"), sums, size + 1) / n
    spread = math.sqrt(max(total[size] - float(total[:size] @ total[:size]), 0.0)) or 1.0
    functions = max(3, round(math.log2(max(1, n / CELL_ROWS))))
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(tables, size, functions))
    offsets = rng.uniform(0, WIDTH * spread, size=(tables, functions))
    mixers = rng.integers(1, 2**63, size=(tables, functions), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return Hashing(total[:size], spread, max(typical_distance(rows, size, k), 1e-9 * spread), directions, offsets, mixers), n


FOUND = "query_id long, vec_id long, score double"


def _meet(k: int):  # noqa: ANN202
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if vectors.num_rows and queries.num_rows:
            vectors = vectors.sort_by("cell").combine_chunks()
            ids, cells = vectors.column("id").to_numpy(), vectors.column("cell").to_numpy()
            x = matrix(vectors.column("v").combine_chunks() if vectors.column("v").num_chunks != 1 else vectors.column("v").chunk(0))
            for own, vector, visited in zip(queries.column("id").to_pylist(), queries.column("v"), queries.column("cells")):
                at = slice(None)
                if visited.is_valid:
                    cell = np.sort(visited.values.to_numpy())
                    first, last = np.searchsorted(cells, cell), np.searchsorted(cells, cell, "right")
                    sizes = last - first
                    at = np.repeat(last - np.cumsum(sizes), sizes) + np.arange(sizes.sum())
                near, score = nearest_of(x[at], ids[at], vector.values.to_numpy().astype(np.float64), own, k)
                out.append((np.full(len(near), own), near, score))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    return run


def _blocks(rows: DataFrame, most: int, into: str) -> DataFrame:
    """key and its number of blocks, of keys with more than `most` rows."""
    return rows.groupBy("key").count().filter(F.col("count") > most).select("key", F.ceil(F.col("count") / most).cast("int").alias(into))


def _compare(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """FOUND: the k nearest of each query within a key. vectors: key, cell, id, v; queries: key, id, v, cells (null: all of the key). The vectors of a key, and its
    queries, are dealt to blocks where they are many, and each block of one meets each of the other."""
    split = _blocks(vectors, BLOCK_ROWS, "parts").join(_blocks(queries, QUERY_ROWS, "turns"), "key", "full").checkpoint()
    parts, turns = (F.coalesce(c, F.lit(1)) for c in ("parts", "turns"))
    own, every = F.pmod(F.xxhash64("id"), parts), F.explode(F.sequence(F.lit(0), turns - 1))
    left = vectors.join(split, "key", "left").select("key", own.cast("int").alias("part"), every.alias("turn"), "cell", "id", "v")
    own, every = F.pmod(F.xxhash64("id"), turns), F.explode(F.sequence(F.lit(0), parts - 1))
    right = queries.join(split, "key", "left").select("key", every.alias("part"), own.cast("int").alias("turn"), "id", "v", "cells")
    by = ["key", "part", "turn"]
    left, right = (side.select(*[F.col(c).alias(c) for c in side.columns]) for side in (left, right))
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_meet(k), FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    each = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(
    vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, tables: int = TABLES,
) -> DataFrame:
    """query_id, rank, vec_id, score: of each query, a row of the same columns, the k nearest vectors with another id that its cells hold, by Euclidean distance; ties
    go to the smaller id. All vectors are indexed. Queries that would visit too many cells, or find fewer than k, are compared with all vectors, in blocks.

    Vectors and queries without an id, or that are null, empty, zero or hold entries that are null or not finite take no part. Rows that repeat an
    id are readings of one vector, of which the nearest counts. An empty table gives an empty one. Other columns aren't read. Vectors of
    unequal lengths raise.
    """
    spark = prepare(vectors.sparkSession)
    rows, asked = known(vectors, id_col, vector_col), known(queries, id_col, vector_col)
    hashing, n = fit(rows, tables, k)
    kind = dict(rows.dtypes)["v"]
    if hashing is None or asked.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    keys = -(-n * tables // KEY_ROWS)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = hashing.cells(matrix(batch.column(1))) if batch.num_rows else np.zeros((0, 1), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1, dtype=np.int32) * np.int32(cells.shape[1])), pa.array(cells.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["id", "v", "cells"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each key that has visited cells; one without a key for queries with too many cells."""
        for batch in batches:
            rows, at, visited = [], [], []
            for k_, query in enumerate(matrix(batch.column(1))):
                cells = hashing.probes(query)
                if cells is None:
                    rows, at, visited = [*rows, k_], [*at, None], [*visited, None]
                    continue
                key = np.mod(cells, keys)
                order = np.argsort(key, kind="stable")
                own, first = np.unique(key[order], return_index=True)
                rows += [k_] * len(own)
                at += own.tolist()
                visited += np.split(cells[order], first[1:])
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), batch.column(1).take(pa.array(rows, pa.int64())), pa.array(at, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(visited, pa.list_(pa.int64()))], ["id", "v", "key", "cells"])

    index = stored(rows.mapInArrow(place, f"id long, v {kind}, cells array<long>"))
    spread = asked.repartition(spark.sparkContext.defaultParallelism)
    visits = stored(spread.mapInArrow(probe, f"id long, v {kind}, key long, cells array<long>"))
    entries = index.select("id", "v", F.explode("cells").alias("cell")).withColumn("key", F.pmod("cell", F.lit(keys)))
    found = stored(_best(_compare(entries, visits.filter("key IS NOT NULL"), k), k))
    # queries with too many cells to visit, or too few vectors in them, meet all vectors
    enough = found.groupBy("query_id").count().filter(F.col("count") >= min(k, n - 1)).select(F.col("query_id").alias("id"))
    rest = stored(visits.join(enough, "id", "left_anti").select("id", "v").distinct())
    if not rest.isEmpty():
        parts = -(-n // KEY_ROWS)
        every = index.select(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("key"), F.lit(0).cast("long").alias("cell"), "id", "v")
        everywhere = rest.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("key"), "id", "v", F.lit(None).cast("array<long>").alias("cells"))
        exact = _best(_compare(every, everywhere, k), k)
        found = found.join(rest.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(exact)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
