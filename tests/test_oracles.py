"""Every registered query with SQL against DuckDB on the same tables; core operators only."""

import math

import duckdb
import pytest

from kinspark.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    tidy = lambda v: round(float(v), 5) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(tidy(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    wanted = duck.execute(ORACLES[name])
    names = [d[0] for d in wanted.description]
    assert sorted(found.columns) == sorted(names)
    got, want = plain(found.collect(), found.columns), plain(wanted.fetchall(), names)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and y is not None and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-5)), (a, b)
