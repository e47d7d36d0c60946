import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm.ann import chi_square_quantile, nearest_neighbours, top_tree, cells_of
from tests.llm.conftest import needs_tables


def brute(vectors, queries, k):
    out = {}
    for q in queries:
        d = sorted((float(np.sqrt(((v.astype(float) - vectors[q].astype(float)) ** 2).sum())), i) for i, v in vectors.items() if i != q)
        out[q] = d[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_recall(spark, spread):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(10, 32))
    vectors = {i: (centres[i % 10] + rng.normal(0, spread, 32)).astype(np.float32) for i in range(1500)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<float>")
    got = found(nearest_neighbours(df, is_query=F.col("vec_id") % 50 == 0, shard_rows=200, query_block=16))
    want = brute(vectors, [i for i in vectors if i % 50 == 0], 10)
    assert set(got) == set(want)
    hits = [len({i for _, i in got[q]} & {i for _, i in want[q]}) / 10 for q in want]
    assert np.mean(hits) >= 0.9
    for q, rows in got.items():
        assert rows == sorted(rows) and len(rows) == 10
        for d, i in rows:
            assert d == pytest.approx(float(np.linalg.norm(vectors[i].astype(float) - vectors[q].astype(float))), abs=1e-12)


def test_odd_vectors_ties_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (5, [0.0, 2.0]), (6, None), (7, [0.0, 0.0]), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [None, 1.0]), (11, [1.0]), (None, [1.0, 1.0]), (5, [0.0, 2.0]), (200, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, 4) for r in rows], "vec_id long, embedding array<double>, score int")
    got = found(nearest_neighbours(df, is_query=F.col("vec_id") % 100 == 0))
    far = math.sqrt(5)
    assert got == {0: [(0.0, 2), (0.0, 3), (0.0, 100), (far, 5)], 100: [(0.0, 0), (0.0, 2), (0.0, 3), (far, 5)]}
    assert nearest_neighbours(df.limit(0), is_query=F.col("vec_id") % 100 == 0).count() == 0


def test_many_equal_vectors(spark):
    df = spark.range(3000).selectExpr("id AS vec_id", "array(1.0D, 2.0D, 3.0D) AS embedding")
    got = found(nearest_neighbours(df, is_query=F.col("vec_id") % 1000 == 0, shard_rows=256))
    assert [i for _, i in got[1000]] == list(range(10)) and [i for _, i in got[0]] == list(range(1, 11))


def test_quantile_and_tree():
    assert chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)
    points = np.random.default_rng(0).normal(size=(1000, 3))
    cells = cells_of(top_tree(points, 16), points)
    assert len(set(cells)) == 16 and np.bincount(cells).max() < 100
    assert len(top_tree(np.ones((50, 3)), 8)) == 1


@needs_tables
def test_query_recall(spark):
    from corpusloom.llm.queries import op6_nearest_neighbours

    d = "/root/testdata/sf0.1"
    vectors = {r["vec_id"]: np.array(r["embedding"], np.float32) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    got = found(op6_nearest_neighbours(spark, d))
    want = brute(vectors, [i for i in vectors if i % 100 == 0], 10)
    assert np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 10 for q in want]) >= 0.9


def test_projections_follow_the_intrinsic_dimension():
    from corpusloom.llm.ann import FEWEST, MOST, intrinsic_dimension, projections_for

    rng = np.random.default_rng(4)
    flat = rng.normal(size=(4000, 4)) @ rng.normal(size=(4, 64))
    assert 3 < intrinsic_dimension(flat) < 5.5 and projections_for(flat) == FEWEST
    assert projections_for(rng.normal(size=(4000, 64))) == MOST
    assert projections_for(np.ones((10, 3))) == FEWEST and projections_for(np.zeros((0, 3))) == FEWEST


def test_a_clustered_shard_is_pruned():
    """Of vectors on a surface of few dimensions a small share is verified; the distances found are exact."""
    from corpusloom.llm.ann import KdTree, projection, projections_for

    rng = np.random.default_rng(5)
    x = rng.normal(size=(8000, 3)) @ rng.normal(size=(3, 48)) + rng.normal(0, 0.01, (8000, 48))
    m = projections_for(x)
    matrix = projection(48, m)
    tree = KdTree(np.arange(8000), x, x @ matrix)
    hits = 0
    for q in range(0, 8000, 400):
        d, ids = tree.nearest(q, x[q], x[q] @ matrix, 10, float("inf"), chi_square_quantile(0.95, m))
        every = np.sqrt(((x - x[q]) ** 2).sum(1))
        every[q] = np.inf
        assert np.array_equal(d, every[ids])
        hits += len(set(ids) & set(np.argsort(every)[:10]))
    assert hits >= 190 and tree.verified < 20 * 8000 * 0.1
