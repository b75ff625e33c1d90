"""The metric tree's results against all products, and its bounds against what they bound."""

from collections import Counter

import duckdb
import numpy as np
import pytest

from factorloom.llm import metric_search, registered

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, every=50, k=5):
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    whole = [(i, v) for i, v in whole if sum(x * x for x in v) < 2**62]
    out = Counter()
    for at, (i, q) in enumerate(whole):
        if i % every == 0:
            found = sorted((-sum(map(int.__mul__, q, v)), j, b) for b, (j, v) in enumerate(whole) if b != at and len(v) == len(q))[:k]
            out.update((i, rank + 1, j, -s) for rank, (s, j, _) in enumerate(found))
    return out


def found(frame, **more):
    return Counter(tuple(r) for r in metric_search.top_products(frame, **more).select("query_id", "rank", "vec_id", "score").collect())


def test_results_equal_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = Counter(con.sql(f"SELECT query_id, rank, vec_id, score FROM ({metric_search.ORACLE_SQL})").fetchall())
    assert Counter(tuple(r) for r in registered.op13_exact_top_k(spark, SF).select("query_id", "rank", "vec_id", "score").collect()) == want
    assert sum(want.values()) == 5 * con.sql("SELECT count(*) FROM embeddings WHERE vec_id % 50 = 0").fetchall()[0][0]


@pytest.mark.parametrize("kind", ["clusters", "copies", "signs", "lengths"])
def test_odd_vectors(spark, monkeypatch, kind):
    for name, value in (("PAGE", 40), ("LEAF", 6), ("QUERIES", 15), ("ROUTES", 5)):
        monkeypatch.setattr(metric_search, name, value)
    rng = np.random.default_rng(len(kind))
    if kind == "clusters":
        centers = rng.standard_normal((6, 8))
        vecs = [(centers[i % 6] + 0.1 * rng.standard_normal(8)).tolist() for i in range(400)]
    elif kind == "copies":
        vecs = [[0.5, -0.25, 0.125] if i % 3 else rng.standard_normal(3).tolist() for i in range(400)]
    elif kind == "signs":
        vecs = [(rng.integers(-2, 3, 4) / 256).tolist() for _ in range(400)]  # many ties, zeros and negative products
    else:
        vecs = [(rng.standard_normal(1 + i % 20) * 10.0 ** (i % 9)).tolist() for i in range(400)]
    rows = [(i, v) for i, v in enumerate(vecs)]
    rows += [(None, vecs[0]), (500, None), (550, []), (600, [None] * len(vecs[0])), (650, [float("nan")] * 3), (700, [float("inf")] * 3), (750, [1e9] * 3), (-50, vecs[1]), (10, vecs[10]), (50, vecs[50]), (50, vecs[50])]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' AS vec", "'clash' AS node", "'clash' AS uid", "'clash' AS page").repartition(5)
    assert found(frame, every=10) == brute(rows, every=10)


def test_empty_and_few(spark):
    assert metric_search.top_products(spark.createDataFrame([], SCHEMA)).count() == 0
    assert metric_search.top_products(spark.createDataFrame([(1, [1.0])], SCHEMA)).count() == 0
    assert found(spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [1.0, 2.0])], SCHEMA)) == Counter({(0, 1, 1, 256 * 512): 1})
    assert found(spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0])], SCHEMA)) == Counter({(0, 1, 0, 65536): 2})


def test_products_are_avoided(spark):
    """Of well-separated clusters, a query works out products with few entries, and finds what all products give."""
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((40, 32))
    vecs = np.floor(256 * (centers[np.arange(2000) % 40] + 0.02 * rng.standard_normal((2000, 32)))).astype(np.int64)
    page = metric_search.Page(vecs, [[{"vec_id": i, "uid": i}] for i in range(2000)])
    best = metric_search.Best(50, 6)
    worked = metric_search.Page.from_bytes(page.to_bytes()).search(vecs[:50], best)
    assert worked < 0.1 * 50 * 2000
    scores = vecs[:50] @ vecs.T
    assert (np.sort(scores, axis=1)[:, ::-1][:, :6] == best.score).all()
