"""Every engine query against its SQL twin at the smallest scale."""

import math

import duckdb
import pytest

from segloom.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def text(v):
    return "" if v is None else (repr(round(v, 6) + 0.0) if isinstance(v, float) and not math.isnan(v) else str(v))


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, db, name):
    df = Q.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(text, r)) for r in df.select(*(f"`{c}`" for c in cols)).collect())
    if name in Q.oracle_sql():
        rel = db.sql(Q.oracle_sql()[name])
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        assert got == sorted(tuple(text(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", ["kmeans_states", "joint_kmeans", "kmeans_quality"])
def test_kmeans_queries_run_all_restarts(spark, monkeypatch, name):
    seeds = []

    class Seen(Q.C.KMeans):
        def __init__(self, **options):
            seeds.append((options["k"], options["seed"]))
            super().__init__(**options)

    monkeypatch.setattr(Q.C, "KMeans", Seen)
    Q.queries()[name](spark, "/root/testdata/sf0.001").count()
    ks = {k for k, _ in seeds}
    assert ks and all(len({s for j, s in seeds if j == k}) == 10 for k in ks)
