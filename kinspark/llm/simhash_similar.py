"""SimHash near-duplicates by similarity: five-word shingles with a Jaccard similarity of 0.8 or more.

The method is that of `simhash`: fingerprints become the bit counts of their segments of two bits, halves of segments meet in a grid
range-join, and what meets is verified exactly. Two texts of that similarity differ in about 15 % of the bits of a fingerprint, too many for
one grid over 64 bits, so the fingerprint is longer and has PARTS grids. Each part has two halves of HALF counts; two texts meet in a part if the
Manhattan distance of its counts is 1 at most. One of its halves is equal then: that is the key by which rows are shuffled. The other
differs in one step at most, which the task finds in its own grid, in the cell of the other half's counts and those one step up.
LANES * 64 further bits drop pairs that meet by chance.

Pairs that are left only say which documents are compared: the documents that they connect, one group, are compared exactly on their sets of
shingles, each with each. No link rests on fingerprints alone, and none of a group is left out. Groups travel as documents dealt
to pairs of blocks and leave a task as spanning forests, never as all their pairs.

Meeting is probabilistic. In one part, pairs of similarity 0.8 differ by 1 at most with a probability of 0.122, and 97.7 % of them meet in one of 29
parts; 99.7 % of those of 0.85 do. More counts in a half, and more parts, keep the cells small in larger corpora.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, as_text, only, prepare, stored
from .components import connected_components

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
#: Parts of two halves; a half has so many segments of two bits, whose counts are 0, 1 or 2.
PARTS, HALF, LANES = 29, 6, 2
PART_BITS = 4 * HALF
CODES = 3**HALF
WORDS = LANES + -(-PARTS * PART_BITS // 64)
#: Of the 128 bits of the lanes, a pair of similarity 0.8 differs in 19.4 on average with a deviation of 4.1, unrelated texts in 64
#: with 5.7. Beyond FAR bits a pair is dropped.
FAR = 36
#: Rows of a cell that one task compares with those of another block.
BLOCK = 1 << 16
#: Documents of a group, and characters of them, that one task compares with those of another block. Blocks of groups of more than GROUP ** 2 / 4 documents grow
#: with the root of their number, so that the rows that are dealt grow by its power of 1.5.
GROUP, CHARS = 128, 1 << 24
#: Rows of whole cells that a task takes at once, about.
ROWS = 1 << 16
#: Cells of the inner grid with up to so many rows give all their close pairs, larger ones a spanning forest.
_SMALL = 32
#: Columns of the matrix of shingles that is multiplied at once.
_COLUMNS = 1 << 13
_WEIGHTS = 3 ** np.arange(HALF)
_COUNTS = np.arange(CODES)[:, None] // _WEIGHTS % 3
#: Of the code of a half, those one step up in one segment; -1 where there is none.
_UP = np.where(_COUNTS < 2, np.arange(CODES)[:, None] + _WEIGHTS, -1)
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the word shingles, A-Z in lower case; of fewer words, that of the whole sequence."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(SHINGLE, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    return np.unique(np.fromiter((digest(flat[i:j], SEED) for i, j in spans), np.uint64))


def long_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WORDS words of 64 bits; a bit is 1 if it is set in over half of the hashes, which are mixed anew for each word."""
    counts = np.zeros(WORDS * 64, np.int64)
    salts = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 255):  # counts of 255 rows fit in a byte
        z = hashes[at : at + 255, None] + salts
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = np.ascontiguousarray(z ^ (z >> np.uint64(31))).astype("<u8", copy=False)
        counts += np.add.reduce(np.unpackbits(z.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")


def halves(fp: np.ndarray) -> np.ndarray:
    """Codes of the bit counts of the segments, a row for each part and a column for each of its halves."""
    bits = np.unpackbits(fp[LANES:].view(np.uint8), bitorder="little")[: PARTS * PART_BITS]
    return bits.reshape(PARTS, 2, HALF, 2).sum(axis=3, dtype=np.int64) @ _WEIGHTS


def cells(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two rows a part for each document that has words: cell (part, half and its code), other (the other half's code), node, and the lanes."""
    heads = np.arange(2 * PARTS, dtype=np.int64) * CODES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, keys, others, lanes = [], [], [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                hashes = shingles(as_text(text.as_py()))
                if not len(hashes):
                    continue
                fp = long_fingerprint(hashes)
                codes = halves(fp)
                nodes.append(node)
                keys.append(codes.ravel() + heads)
                others.append(codes[:, ::-1].ravel())
                lanes.append(fp[:LANES].view("<i8"))
            if nodes:
                each = np.repeat(np.stack(lanes), 2 * PARTS, axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).astype(np.int32)), pa.array(np.concatenate(others).astype(np.int32)),
                     pa.array(np.repeat(np.array(nodes, np.int64), 2 * PARTS)), pa.array(each[:, 0]), pa.array(each[:, 1])],
                    ["cell", "other", "node", "a", "b"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")).filter("node IS NOT NULL")
    return rows.mapInArrow(run, "cell int, other int, node long, a long, b long")


def dealt(rows: DataFrame, split: DataFrame, key: str) -> DataFrame:
    """Adds own, i and j. Rows of a key that has several blocks, a table (key, blocks), have one of their own and go to each pair of blocks that it takes part in."""
    if split.isEmpty():
        return rows.withColumns({c: F.lit(0) for c in ("own", "i", "j")})
    own = F.coalesce(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.lit(0))
    every = F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)
    meets = F.transform(every, lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    placed = rows.join(split, key, "left").withColumn("own", own).withColumn("meets", F.explode(meets))
    return placed.select(*rows.columns, "own", "meets.i", "meets.j")


def _distance(a: np.ndarray, b: np.ndarray, u: np.ndarray | int, v: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[u] ^ a[v]).astype(np.int64) + np.bitwise_count(b[u] ^ b[v])


def _spanning(size: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Index pairs of a spanning forest; near(k, left) says which of left are next to k."""
    left, found = np.arange(size), []
    while len(left):
        open_, left = [int(left[0])], left[1:]
        while open_ and len(left):
            at = open_.pop()
            reached = near(at, left)
            new, left = left[reached], left[~reached]
            open_ += new.tolist()
            if len(new):
                found.append(np.stack((np.full(len(new), at), new), axis=1))
    return np.concatenate(found) if found else np.empty((0, 2), np.int64)


def _close(group: np.ndarray, other: np.ndarray, node: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Index pairs of rows of a group whose other halves are one step apart at most and whose lanes differ in FAR bits at most: all of them, or a forest that
    connects them."""
    rows, keys, steps = [np.arange(len(group))], [group * CODES + other], [np.zeros(len(group), np.int64)]
    for k in range(HALF):
        up = _UP[other, k]
        has = np.flatnonzero(up >= 0)
        rows.append(has)
        keys.append(group[has] * CODES + up[has])
        steps.append(np.ones(len(has), np.int64))
    row, key, step = (np.concatenate(x) for x in (rows, keys, steps))
    order = np.argsort(2 * key + step, kind="stable")
    row, key, step = row[order], key[order], step[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(key)])))
    # of two rows that meet, one lies in its own cell at least; rows in their own cells come first
    active = np.flatnonzero((step == 0) & np.repeat(sizes <= _SMALL, sizes))
    found = []
    for k in range(1, _SMALL):
        active = active[active + k < len(key)]
        active = active[key[active + k] == key[active]]
        if not len(active):
            break
        u, v = row[active], row[active + k]
        near = (_distance(a, b, u, v) <= FAR) & (node[u] != node[v])
        found.append(np.stack((u[near], v[near]), axis=1))
    for g in np.flatnonzero((sizes > _SMALL) & (step[starts] == 0)).tolist():
        s = slice(starts[g], starts[g] + sizes[g])
        at, stepped = row[s], step[s] == 1
        pairs = _spanning(len(at), lambda k, left: (_distance(a, b, at[k], at[left]) <= FAR) & ~(stepped[k] & stepped[left]))  # noqa: B023
        found.append(at[pairs])
    return np.concatenate(found) if found else np.empty((0, 2), np.int64)


def _tree(pairs: np.ndarray) -> np.ndarray:
    """The pairs that link what those before did not."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    kept = []
    for k, (u, v) in enumerate(pairs.tolist()):
        u, v = find(u), find(v)
        if u != v:
            parent[v] = u
            kept.append(k)
    return pairs[kept]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a forest of the pairs that meet, from rows (cell, i, j, node, other, a, b) sorted by (cell, i, j); groups may go over the ends of batches."""

    def pairs(rows: list[np.ndarray]) -> pa.RecordBatch:
        cell, i, j, node, other = (r.astype(np.int64) for r in rows[:5])
        change = np.concatenate(([True], (cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        found = _close(np.cumsum(change) - 1, other, node, rows[5].view(np.uint64), rows[6].view(np.uint64))
        found = _tree(np.sort(node[found], axis=1))
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["u", "v"])

    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append([batch.column(c).to_numpy() for c in range(7)])
        size += batch.num_rows
        if size < ROWS:
            continue
        rows = [np.concatenate(x) for x in zip(*held)]
        other = np.flatnonzero(np.any([r != r[-1] for r in rows[:3]], axis=0))
        last = int(other[-1]) + 1 if len(other) else 0
        if last:
            yield pairs([r[:last] for r in rows])
        held = [[r[last:] for r in rows]]
        size = len(held[0][0]) if last else 0  # a group that goes on is looked at again after as many rows
    if held:
        rows = [np.concatenate(x) for x in zip(*held)]
        if len(rows[0]):
            yield pairs(rows)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """u < v: pairs of documents that meet and differ in FAR bits of the lanes at most; enough of them to connect all that do."""
    rows = stored(cells(docs, id_col, text_col))
    sizes = rows.groupBy("cell").count().filter(F.col("count") > BLOCK)
    split = sizes.select("cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")).checkpoint()
    placed = dealt(rows, split, "cell").select("cell", "i", "j", "node", "other", "a", "b")
    sorted_rows = placed.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return sorted_rows.mapInArrow(_meet, "u long, v long").distinct()


def alike(sets: list[np.ndarray], blocks: np.ndarray) -> np.ndarray:
    """Index pairs of a spanning forest of the similar ones among sorted sets: of different blocks, or all if there is but one."""
    flat, lengths = np.concatenate(sets), np.array([len(x) for x in sets])
    _, at, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts > 1
    column, owner = (np.cumsum(shared) - 1)[at], np.repeat(np.arange(len(sets)), lengths)
    column, owner = column[shared[at]], owner[shared[at]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((len(sets), len(sets)), np.int64)
    for first in range(0, int(shared.sum()), _COLUMNS):
        lo, hi = np.searchsorted(column, (first, first + _COLUMNS))
        held = np.zeros((len(sets), min(_COLUMNS, int(column[hi - 1]) + 1 - first)), np.float32)
        held[owner[lo:hi], column[lo:hi] - first] = 1
        both += (held @ held.T).astype(np.int64)
    # in whole numbers, so that exactly 0.8 counts
    near = 10 * both >= round(10 * SIMILARITY) * (lengths[:, None] + lengths - both)
    if blocks.min() != blocks.max():
        near &= blocks[:, None] != blocks
    return _spanning(len(sets), lambda k, left: near[k, left])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows (root, i, j, own, node, text) sorted by (root, i, j)."""

    def out(group: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
        own, node, sets = zip(*group)
        return np.sort(np.array(node, np.int64)[alike(list(sets), np.array(own))], axis=1)

    def batch_of(links: list[np.ndarray]) -> pa.RecordBatch:
        u, v = np.concatenate(links).T
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    at, group = None, []
    for batch in batches:
        links = [np.empty((0, 2), np.int64)]
        for *key, own, node, text in zip(*(batch.column(c).to_pylist() for c in range(6))):
            if key != at:
                if len(group) > 1:
                    links.append(out(group))
                at, group = key, []
            group.append((own, node, shingles(as_text(text))))
        yield batch_of(links)
    if len(group) > 1:
        yield batch_of([out(group)])


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """u < v: similar documents, all of them verified; pairs that other links of their task connect already are left out."""
    prepare(docs.sparkSession)
    roots = connected_components(candidates(docs, id_col, text_col))
    members = roots.union(roots.select(F.col("root").alias("node"), "root").distinct()).checkpoint()
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")).filter("node IS NOT NULL")
    texts = only(texts, members, "node").groupBy("node").agg(F.min("text").alias("text"))
    rows = stored(texts.join(members, "node"))
    blocks = F.ceil(F.greatest(F.least(F.count("*") / GROUP, F.sqrt(F.count("*")) / 2), F.sum(F.length("text")) / CHARS))
    split = rows.groupBy("root").agg(F.least(blocks, F.count("*")).cast("int").alias("blocks")).filter("blocks > 1").checkpoint()
    placed = dealt(rows, split, "root").select("root", "i", "j", "own", "node", "text")
    return placed.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_compare, "u long, v long").checkpoint()


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of its component of similar documents, with all their columns. A row goes only if a verified pair of its own
    links it to the component.

    Rows without an id and texts without words (null, empty, whitespace) stay. An id names one document: rows that repeat it stay or
    go together. An empty table gives an empty one. Texts of any length are read whole; columns may have any names.
    """
    gone = connected_components(links(docs, id_col, text_col)).select(F.col("node").alias("_gone"))
    return docs.join(gone, docs[id_col].cast("long") == gone["_gone"], "left_anti")
