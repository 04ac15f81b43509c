"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is mapped to the bit counts of its segments. The Manhattan distance of these vectors never exceeds the Hamming
distance, so a range join over a grid of them loses no pair: of the two halves of a fingerprint, one differs in at most one
count if at most three bits differ in all. Fingerprints therefore meet in the cell of their own half-vector and in the neighbouring
cells one step up; those that meet are verified exactly.

Cells with many fingerprints are split into blocks that meet in pairs, each task holding one block, and only the links of
a spanning forest leave a cell, so that a group of n near copies makes about n links and not n * n.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, as_text, prepare
from .components import connected_components

SHINGLE, SEED = 3, 42
#: Fingerprints link at so many differing bits or fewer; the halves of the grid join rest on it.
LINK_BITS = 3
#: Segments have two bits: 32 of them, 16 in each half.
SEGMENTS = 16
#: Fingerprints of a cell that one task holds.
BLOCK = 4096
#: Split cells are broadcast up to so many, else joined by a shuffle.
BROADCAST_ROWS = 100_000
_SMALL = 32
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_HASHES = 1 << 16


def fingerprint(text: str) -> int:
    """64 bits, signed: a bit is 1 if it is set in over half of the hashes of the shingles."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(SHINGLE, len(words))
    starts, ends = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _HASHES):
        hashes = np.array([digest(flat[i:j], SEED) for i, j in zip(starts[at : at + _HASHES], ends[at : at + _HASHES])], np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp of every row; a null text, or one without words, has the fingerprint 0."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(as_text(t.as_py())) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def cells(nodes: DataFrame) -> DataFrame:
    """node, fp and, for each half, the cell of its own (probe = 0) and those one step up in one segment (probe = 1).

    A cell holds the half and sixteen bit counts of 0 to 2, two bits each.
    """
    pairs = F.lit(0x55555555)

    def cell(half: int) -> Column:
        bits = F.shiftrightunsigned("fp", 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
        return bits.bitwiseAND(pairs) + F.shiftrightunsigned(bits, 1).bitwiseAND(pairs) + F.lit(half << 33)

    def around(own: Column) -> Column:
        steps = F.array(*[
            F.when(F.shiftrightunsigned(own, 2 * s).bitwiseAND(F.lit(3)) < 2, own + F.lit(1 << (2 * s))) for s in range(SEGMENTS)
        ])
        up = F.transform(F.filter(steps, lambda c: c.isNotNull()), lambda c: F.struct(c.alias("cell"), F.lit(1).alias("probe")))
        return F.concat(F.array(F.struct(own.alias("cell"), F.lit(0).alias("probe"))), up)

    both = F.concat(around(cell(0)), around(cell(1)))
    return nodes.select("node", "fp", F.explode(both).alias("at")).select("node", "fp", "at.cell", "at.probe")


def dealt(placed: DataFrame) -> DataFrame:
    """Adds i and j, the pair of blocks in which a row takes part; cells of up to BLOCK fingerprints have one block."""
    sizes = placed.filter("probe = 0").groupBy("cell").count().filter(F.col("count") > BLOCK)
    split = sizes.select("cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")).checkpoint()
    small = split.count() <= BROADCAST_ROWS
    rows = placed.join(F.broadcast(split) if small else split, "cell", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    meets = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))))
    meets = meets.when(F.col("probe") == 1, F.transform(every, lambda b: F.struct(b.alias("i"), b.alias("j"))))
    meets = meets.otherwise(F.transform(every, lambda b: F.struct(F.least(b, own).alias("i"), F.greatest(b, own).alias("j"))))
    side = F.when((F.col("probe") == 0) & (F.col("i") != F.col("j")) & (own == F.col("j")), 1).otherwise(F.col("probe"))
    return rows.withColumn("meets", F.explode(meets)).select("cell", "meets.i", "meets.j", "node", "fp", "probe", "blocks").select(
        "cell", "i", "j", side.alias("side"), "node", "fp"
    )


class _Forest:
    """Union-find over the rows of a block."""

    def __init__(self, size: int):
        self.parent = list(range(size))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(self, pairs: np.ndarray) -> list[int]:
        """The indexes of the pairs that link what wasn't linked yet."""
        new = []
        for k, (a, b) in enumerate(pairs.tolist()):
            a, b = self.find(a), self.find(b)
            if a != b:
                self.parent[b] = a
                new.append(k)
        return new


def _close(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(np.bitwise_count(left[:, None] ^ right[None, :]) <= LINK_BITS)


class Linker:
    """Links of one large group whose rows come in order of side: the rows of side 0 are held, at most about BLOCK of them;
    those of side 1 pass by."""

    CHUNK = 512

    def __init__(self, inside: bool):
        self.inside, self.fp, self.node = inside, np.empty(0, np.uint64), np.empty(0, np.int64)
        self.forest: _Forest | None = None
        self.links: list[np.ndarray] = []

    def add(self, side: np.ndarray, fp: np.ndarray, node: np.ndarray) -> None:
        held = side == 0
        self.fp, self.node = np.concatenate((self.fp, fp[held])), np.concatenate((self.node, node[held]))
        if not held.all() and len(self.fp):
            self._start()
            self._pass(fp[~held], node[~held])

    def _start(self) -> None:
        if self.forest is None:
            self.forest = _Forest(len(self.fp))
            if self.inside:
                for at in range(0, len(self.fp), self.CHUNK):
                    a, b = _close(self.fp[at : at + self.CHUNK], self.fp[at:])
                    pairs = np.stack((a + at, b + at), axis=1)[a < b]
                    self._emit(pairs)

    def _emit(self, pairs: np.ndarray) -> None:
        new = pairs[self.forest.join(pairs)]
        self.links.append(np.stack((self.node[new[:, 0]], self.node[new[:, 1]]), axis=1))

    def _pass(self, fp: np.ndarray, node: np.ndarray) -> None:
        for at in range(0, len(fp), self.CHUNK):
            p, b = _close(fp[at : at + self.CHUNK], self.fp)
            if not len(p):
                continue
            first = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
            self.links.append(np.stack((node[at + p[first]], self.node[b[first]]), axis=1))
            head = b[first][np.cumsum(np.concatenate(([True], p[1:] != p[:-1]))) - 1]
            meet = np.unique(head * np.int64(len(self.fp)) + b)
            pairs = np.stack(np.divmod(meet, len(self.fp)), axis=1)
            # what one passing fingerprint links is linked by its own links already; they only have to meet in its first
            rest = pairs[pairs[:, 0] != pairs[:, 1]]
            self._emit(rest)

    def end(self) -> np.ndarray:
        if len(self.fp):
            self._start()
        return np.concatenate(self.links) if self.links else np.empty((0, 2), np.int64)


def _small_links(group: np.ndarray, side: np.ndarray, fp: np.ndarray, node: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Links in groups of up to _SMALL rows, for many groups at once: row k is compared with row k + 1, k + 2 and so on."""
    found = []
    for k in range(1, _SMALL):
        near = np.flatnonzero((group[k:] == group[:-k]) & (side[:-k] == 0))
        if not len(near):
            break
        near = near[inside[near] | (side[near + k] == 1)]
        near = near[np.bitwise_count(fp[near] ^ fp[near + k]) <= LINK_BITS]
        found.append(np.stack((node[near], node[near + k]), axis=1))
    return np.concatenate(found) if found else np.empty((0, 2), np.int64)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of sorted rows (cell, i, j, side, node, fp); groups may go over the ends of batches."""

    def out(links: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["u", "v"])

    held: list[np.ndarray] | None = None  # rows of the group that isn't known to have ended
    large: Linker | None = None
    at = None
    for batch in batches:
        cell, i, j, side, node = (batch.column(c).to_numpy().astype(np.int64) for c in range(5))
        rows = [cell, i, j, side, node, batch.column(5).to_numpy().view(np.uint64)]
        if not len(cell):
            continue
        if large is not None:
            same = (cell == at[0]) & (i == at[1]) & (j == at[2])
            large.add(side[same], rows[5][same], node[same])
            if same.all():
                continue
            yield out(large.end())
            large, rows = None, [r[~same] for r in rows]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        cell, i, j, side, node, fp = rows
        change = np.concatenate(([True], (cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        starts = np.flatnonzero(change)
        sizes = np.diff(np.concatenate((starts, [len(cell)])))
        last = starts[-1]
        group = np.cumsum(change) - 1
        done = np.arange(len(cell)) < last
        little = done & (sizes[group] <= _SMALL)
        yield out(_small_links(group[little], side[little], fp[little], node[little], (i == j)[little]))
        for k in np.flatnonzero(sizes[:-1] > _SMALL):
            s = slice(starts[k], starts[k] + sizes[k])
            if side[s.start] == 0:
                linker = Linker(bool(i[s.start] == j[s.start]))
                linker.add(side[s], fp[s], node[s])
                yield out(linker.end())
        held = [r[last:] for r in rows]
        if len(held[0]) > _SMALL:
            at = (cell[last], i[last], j[last])
            large = Linker(bool(i[last] == j[last]))
            large.add(held[3], held[5], held[4])
            held = None
    if large is not None:
        yield out(large.end())
    elif held is not None:
        cell, i, j, side, node, fp = held
        yield out(_small_links(np.zeros(len(cell), np.int64), side, fp, node, i == j))


def links(nodes: DataFrame) -> DataFrame:
    """u, v: nodes whose fingerprints differ in at most LINK_BITS bits; enough of these pairs to connect all that are linked."""
    rows = dealt(cells(nodes)).repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "side", "node")
    return rows.mapInArrow(_verify, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links).

    Null and empty texts have the fingerprint 0 and link like any other. Equal fingerprints are joined before any pair is
    looked for, so repeated rows and exact copies make no pairs. A row with a null doc_id gets its fingerprint and the component of
    rows with that fingerprint; it connects no others, and its component_id is null if no id shares its fingerprint. An
    empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    rows = fingerprints(docs, id_col, text_col).checkpoint()
    nodes = rows.filter(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("node")).checkpoint()
    roots = connected_components(links(nodes))
    classes = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return rows.join(classes, "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
