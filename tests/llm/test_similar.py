"""The similarity form of the SimHash operator against brute force over sets of shingles."""

import random
import re

import numpy as np
import pytest

from kinspark.llm import simhash_similar

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = SPACE.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def firsts(rows):
    """Ids that stay: the smallest of each component of texts with a Jaccard similarity of 0.8 or more."""
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 10 * len(a & b) >= 8 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i for i in root if find(i) == i}


def edited(words, rate, rng):
    return " ".join(f"edit{rng.random():.9f}" if rng.random() < rate else w for w in words)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string").selectExpr(
        "*", "1 as u", "2 as _gone", "3 as root", "4 as cell"
    )


@pytest.mark.parametrize("block", [1024, 16])
def test_groups_of_near_copies(spark, block, monkeypatch):
    monkeypatch.setattr(simhash_similar, "BLOCK", block)
    rng = random.Random(5)
    rows, at = [], 0
    for size, length, rate in ((60, 300, 0.006), (8, 40, 0.01), (3, 2000, 0.01), (2, 9, 0), (40, 120, 0.01)):
        base = [f"w{rng.randrange(3000)}" for _ in range(length)]
        for _ in range(size):
            rows.append((at, edited(base, rate, rng)))
            at += 1
    rows += [(at + k, " ".join(f"w{rng.randrange(3000)}" for _ in range(80))) for k in range(60)]
    rng.shuffle(rows)
    kept = {r.doc_id for r in simhash_similar.keep_first(frame(spark, rows)).collect()}
    assert kept == firsts(rows)


def test_awkward_rows(spark):
    long = " ".join(f"v{k * k % 9973}" for k in range(300_000))
    rows = [
        (5, None), (6, ""), (7, " \n"), (8, "One two"), (9, "one TWO"), (10, "one two three"), (None, "one two"), (None, None), (9, "one two"),
        (11, long), (12, long + " tail"), (13, "Ünï çödé Ä"), (14, "ünï çödé Ä"),
    ]
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in simhash_similar.keep_first(frame(spark, rows)).collect())
    assert kept == sorted([(True, 0)] * 2 + [(False, i) for i in (5, 6, 7, 8, 10, 11, 13, 14)])
    assert simhash_similar.keep_first(frame(spark, rows).limit(0)).collect() == []


def test_similarity_at_the_bound():
    words = [f"w{k}" for k in range(13)]
    one, two = " ".join(words[:13]), " ".join(words[1:12])
    a, b = simhash_similar.shingles(one), simhash_similar.shingles(two)
    assert (len(a), len(b), len(np.intersect1d(a, b))) == (9, 7, 7) and 7 / 9 < 0.8
    assert firsts([(1, one), (2, two)]) == {1, 2}
    assert firsts([(1, " ".join(words[:9])), (2, " ".join(words[:8]))]) == {1}


def test_groups_at_the_bound(spark, monkeypatch):
    """Groups of 40 whose pairs lie on both sides of 0.8: all pairs that share a cell and are similar end up together, and no others."""
    monkeypatch.setattr(simhash_similar, "BLOCK", 32)
    rng = random.Random(11)
    rows = []
    for _ in range(4):
        base = [f"w{rng.randrange(3000)}" for _ in range(150)]
        for _ in range(40):
            words = list(base)
            for at in rng.sample(range(len(words)), 2):
                words[at] = f"edit{rng.random():.9f}"
            rows.append((len(rows), " ".join(words)))
    docs = frame(spark, rows)
    sets = dict((i, shingle_set(t)) for i, t in rows)
    by_cell, lanes = {}, {}
    for r in simhash_similar.cells(docs, "doc_id", "text").collect():
        by_cell.setdefault(r.cell, []).append(r.node)
        lanes[r.node] = (r.a % 2**64, r.b % 2**64)
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    met = {(u, v) for nodes in by_cell.values() for u in nodes for v in nodes if u < v}
    far = lambda u, v: sum((x ^ y).bit_count() for x, y in zip(lanes[u], lanes[v]))
    similar = lambda u, v: 10 * len(sets[u] & sets[v]) >= 8 * len(sets[u] | sets[v])
    near = {(u, v) for u, v in met if far(u, v) <= simhash_similar.FAR}
    assert any(not similar(*p) for p in near)
    for u, v in near:
        if similar(u, v):
            x, y = find(u), find(v)
            root[max(x, y)] = min(x, y)
    assert {r.doc_id for r in simhash_similar.keep_first(docs).collect()} == {i for i in root if find(i) == i}
    for r in simhash_similar.links(docs).collect():
        assert similar(r.u, r.v)


def test_range_join(spark):
    """Rows meet whose counts differ by one step in a part; pairs that no half shares are never looked at."""
    rng = np.random.default_rng(3)
    size = 400
    counts = rng.integers(0, 3, (size, simhash_similar.HALF))
    code = counts @ simhash_similar._WEIGHTS
    lanes = rng.integers(0, 2**63, 6).astype(np.uint64)[rng.integers(0, 6, size)]
    group, zero = np.sort(rng.integers(0, 3, size)), np.zeros(size, np.uint64)
    found = {tuple(sorted(p)) for p in simhash_similar._tree(np.sort(simhash_similar._close(group, code, np.arange(size), lanes, zero), axis=1)).tolist()}
    apart = np.abs(counts[:, None] - counts).sum(axis=2)
    far = np.bitwise_count(lanes[:, None] ^ lanes)
    near = (apart <= 1) & (far <= simhash_similar.FAR) & (group[:, None] == group)
    assert all(near[p] for p in found)
    root = list(range(size))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def parts(pairs):
        root[:] = range(size)
        for u, v in pairs:
            x, y = find(u), find(v)
            root[max(x, y)] = min(x, y)
        return [find(x) for x in range(size)]

    assert parts(found) == parts(np.argwhere(np.triu(near, 1)).tolist())


def test_counts_of_segments():
    """Each code holds the bit counts of six segments of two bits."""
    fp = simhash_similar.long_fingerprint(simhash_similar.shingles(" ".join(f"w{k}" for k in range(90))))
    bits = [int(w) >> k & 1 for w in fp for k in range(64)][64 * simhash_similar.LANES :]
    for part, row in enumerate(simhash_similar.halves(fp).tolist()):
        for half, code in enumerate(row):
            at = part * simhash_similar.PART_BITS + half * 2 * simhash_similar.HALF
            assert [code // 3**k % 3 for k in range(simhash_similar.HALF)] == [bits[at + 2 * k] + bits[at + 2 * k + 1] for k in range(simhash_similar.HALF)]


def test_large_group_in_blocks(spark):
    """A group of 400 texts around the bound: the same components as by brute force, and few rows of links rather than its pairs."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    rows = [(k, " ".join(f"edit{rng.random():.9f}" if rng.random() < 0.03 * (k % 3) / 2 else w for w in base)) for k in range(400)]
    docs = frame(spark, rows)
    assert {r.doc_id for r in simhash_similar.keep_first(docs).collect()} == firsts(rows)
    blocks = -(-len(rows) // simhash_similar.GROUP)
    assert simhash_similar.candidates(docs).count() <= 2 * simhash_similar.PARTS * len(rows)
    assert simhash_similar.links(docs).count() <= blocks * len(rows)
