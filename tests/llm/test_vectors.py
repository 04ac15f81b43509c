"""Whitening and nearest neighbours against plain linear algebra and full comparison."""

import math

import numpy as np
import pytest

from kinspark.llm import nearest, queries, whitening

SF = "/root/testdata/sf0.01"
EXTRA = ("id", "v", "cell", "cells", "key", "block", "sums", "slot", "component")


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", *[f"'x' as {c}" for c in EXTRA])


def bad():
    nan, inf = math.nan, math.inf
    return [(901, None), (902, []), (903, [1.0, None, 2.0]), (904, [nan, 1.0, 2.0]), (905, [inf, 0.0, 0.0]), (906, [0.0, -inf, 1.0])]


def whitened(vectors):
    """n, deviations, eigenvalues and vectors of the whole numbers' covariance."""
    x = np.floor(64 * np.asarray(vectors, float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    return n, ((n * x - s) ** 2).sum(axis=1), e[::-1], u[:, ::-1], c


@pytest.mark.parametrize("shape", ["full", "deficient", "stretched"])
def test_whitening(spark, shape):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(120, 6)) * ([1, 2, 3, 4, 5, 6] if shape != "stretched" else [1e5, 1, 1, 3, 4, 5])
    if shape == "deficient":
        base[:, 5], base[:, 4] = base[:, 0], 2.0
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(base)] + [(7, [float(v) for v in base[7]]), (None, [float(v) for v in base[8]])] + [
        (i, v and [*v, 1.0, 1.0, 1.0]) for i, v in bad()
    ]
    table = frame(spark, rows, "double")
    found = whitening.whitened_rows(table).collect()
    good = [r for r in rows if r[0] is None or r[0] < 900]
    n, deviation, e, u, c = whitened([v for _, v in good])
    rank = 4 if shape == "deficient" else 6
    assert len(found) == 6 * n and {r.n for r in found} == {n}
    by = {}
    for r in found:
        by.setdefault((r.vec_id, r.component), []).append(r)
    for k, ((i, _), d) in enumerate(zip(good, deviation)):
        for j in range(6):
            own = by[i, j + 1]
            assert len(own) == (2 if i == 7 else 1) and own[0].deviation == d
            assert math.isclose(own[0].explained, e[j] / e.sum(), rel_tol=1e-6, abs_tol=1e-12)
            want = abs(c[k] @ u[:, j]) / math.sqrt(e[j]) if j < rank else None
            assert own[0].whitened is None if want is None else math.isclose(abs(own[0].whitened), want, rel_tol=1e-6, abs_tol=1e-8)
    assert max(r.identity_error for r in found) < 1e-6
    signs = {(r.component, np.sign(r.whitened * (c[k] @ u[:, r.component - 1]))) for k, (i, _) in enumerate(good) for r in by[i, 1]}
    assert len(signs) == 1


def test_whitening_edges(spark):
    empty = whitening.whitened_rows(frame(spark, bad()))
    assert empty.collect() == [] and empty.columns[:3] == ["vec_id", "component", "n"]
    one = whitening.whitened_rows(frame(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained) for r in one] == [(1, 1, 0, None, None), (2, 1, 0, None, None)]
    large = whitening.whitened_rows(frame(spark, [(1, [1e13, 2.0]), (2, [0.0, 0.0])], "double")).collect()
    assert {r.deviation for r in large} == {None}
    with pytest.raises(ValueError, match="entries"):
        whitening.whitened_rows(frame(spark, [(1, [1.0]), (2, [1.0, 2.0])]))


def test_whitening_query(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviation, e, u, c = whitened([r.embedding for r in vectors])
    place = {r.vec_id: k for k, r in enumerate(vectors)}
    found = queries.op12_whitening(spark, SF).collect()
    assert len(found) == 32 * n
    want = np.abs(c @ u / np.sqrt(e))
    for r in found:
        k = place[r.vec_id]
        assert r.deviation == deviation[k] and math.isclose(abs(r.whitened), want[k, r.component - 1], rel_tol=1e-8, abs_tol=1e-9)
        assert math.isclose(r.explained, e[r.component - 1] / e.sum(), rel_tol=1e-9) and r.identity_error < 1e-9


def compared(rows, queried, k=10):
    """query: (distance, id) of the nearest, of all rows with another id; rows that repeat an id count by the nearest."""
    out = {}
    for q, v in queried:
        for i, w in rows:
            if i != q:
                d = math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w)))
                own = out.setdefault(q, {})
                own[i] = min(own.get(i, d), d)
    return {q: sorted((d, i) for i, d in own.items())[:k] for q, own in out.items()}


def recall(found, exact):
    by = {}
    for r in found:
        by.setdefault(r.query_id, []).append(r)
    hit = total = 0
    for q, want in exact.items():
        own = sorted(by.get(q, []), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, len(own) + 1)) and len(own) == len(want)
        assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        hit += len({r.vec_id for r in own} & {i for _, i in want})
        total += len(want)
    return hit / total


@pytest.mark.parametrize("sizes", [(4096, 2048, 1024, 4096), (64, 16, 5, 4096), (64, 16, 5, 2)])
def test_search(spark, sizes, monkeypatch):
    """Clusters, one of them most of the rows, copies, ties and rows that take no part; with hot cells, many queries a key, and full comparison."""
    for name, value in zip(("KEY_ROWS", "BLOCK_ROWS", "QUERY_ROWS", "MOST_PROBES"), sizes):
        monkeypatch.setattr(nearest, name, value)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8)) * 3
    points = [centres[0] + rng.normal(size=8) * 0.05 for _ in range(200)] + [centres[k % 12] + rng.normal(size=8) for k in range(200)]
    rows = [(k, [float(np.float32(v)) for v in p]) for k, p in enumerate(points)]
    rows += [(400 + k, rows[3][1]) for k in range(5)] + [(7, rows[250][1])]
    table = frame(spark, rows + [(i, v and [*v, *[1.0] * 5]) for i, v in bad()] + [(None, rows[0][1]), (500, [0.0] * 8)])
    queried = [r for r in rows if r[0] % 10 == 0 or r[0] in (3, 7, 401)]
    asked = frame(spark, queried + [(901, None), (500, [0.0] * 8), (None, rows[0][1])])
    found = nearest.search(table, asked).collect()
    exact = compared(rows, queried)
    assert {r.query_id for r in found} == set(exact)
    assert recall(found, exact) >= 0.9
    vectors = {}
    for i, v in rows:
        vectors.setdefault(i, []).append(v)
    for r in found:
        pairs = [math.dist(a, b) for a in vectors[r.query_id] for b in vectors[r.vec_id]]
        assert any(math.isclose(r.score, d, rel_tol=1e-12, abs_tol=1e-12) for d in pairs)


def test_few_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])]
    found = nearest.search(frame(spark, rows), frame(spark, rows[:1])).collect()
    assert sorted((r.rank, r.vec_id, round(r.score, 6)) for r in found) == [(1, 3, 1.0), (2, 2, 1.414214)]
    assert nearest.search(frame(spark, rows[:1]), frame(spark, rows[:1])).collect() == []
    assert nearest.search(frame(spark, bad()), frame(spark, rows[:1])).collect() == []
    assert nearest.search(frame(spark, rows), frame(spark, bad())).collect() == []


def test_search_query(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = queries.op13_nearest(spark, SF).collect()
    assert recall(found, compared(rows, [r for r in rows if r[0] % 100 == 0])) >= 0.9


def test_visits_in_order():
    rng = np.random.default_rng(6)
    chance = rng.dirichlet(np.ones(4), size=3)
    found = nearest.best_first(chance, 2.0)
    product = [float(np.prod(chance[np.arange(3), row])) for row in found]
    assert np.all(np.diff(product) <= 1e-12) and len({tuple(r) for r in found}) == len(found) == 64
