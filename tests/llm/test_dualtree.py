"""Centroid clustering against plain Python integers."""

import hashlib
import math

import numpy as np
import pytest

from corpusloom.llm import dualtree as T

DIM = 6


def brute(rows, dim, clusters, rounds, seed=3, scale=1024):
    fine = [(i, v) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    x = [(i, [math.floor(scale * c) for c in v]) for i, v in fine]
    first = sorted(x, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    at = [v for _, v in first[:clusters]]
    gap = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    best = lambda v: min((gap(v, c), k) for k, c in enumerate(at))
    for _ in range(rounds):
        of = [best(v)[1] for _, v in x]
        members = [[v for (_, v), k in zip(x, of, strict=True) if k == c] for c in range(len(at))]
        at = [[sum(col) // len(m) for col in zip(*m, strict=True)] if m else at[c] for c, m in enumerate(members)]
    final = [(i, *best(v)) for i, v in x]
    inertia = {c: sum(d for _, d, k in final if k == c) for c in range(len(at))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    fits = lambda v: v if v < 2**63 else None
    return sorted([(i, k, fits(d), fits(inertia[k]), fits(sum(inertia.values())), sha[k]) for i, d, k in final], key=str)


def answer(spark, rows, kind="double", **how):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    return sorted(map(tuple, T.cluster_vectors(df, dim=DIM, **how).collect()), key=str)


def grouped(seed, n):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, DIM))
    return [(i, (centres[rng.integers(5)] + 0.05 * rng.normal(size=DIM)).tolist()) for i in range(n)]


@pytest.mark.parametrize("shard_rows", [16, 1024])
@pytest.mark.parametrize("clusters", [1, 8, 30])
def test_against_brute_force(spark, shard_rows, clusters):
    rows = grouped(clusters, 400)
    assert answer(spark, rows, clusters=clusters, rounds=4, shard_rows=shard_rows, pivots=4) == brute(rows, DIM, clusters, 4)


def test_ties_and_copies(spark):
    """Points on a coarse grid, with many at equal distances and many equal, equal starts too."""
    rng = np.random.default_rng(2)
    rows = [(int(i // 2), (rng.integers(0, 3, DIM) / 1024).tolist()) for i in range(300)] + [(7, [0.0] * DIM)] * 200
    assert answer(spark, rows, clusters=8, rounds=5, shard_rows=32) == brute(rows, DIM, 8, 5)
    same = [(i, [1.0] * DIM) for i in range(50)]
    assert answer(spark, same, clusters=8, rounds=2) == brute(same, DIM, 8, 2)


def test_odd_rows(spark):
    rows = [*grouped(4, 40), (None, [0.5] * DIM), (None, [0.25] * DIM), (90, None), (91, []), (92, [1.0] * (DIM + 1)), (93, [float("nan"), *[1.0] * (DIM - 1)]), (94, [float("inf"), *[1.0] * (DIM - 1)]), (95, [None, *[1.0] * (DIM - 1)]), (96, [0.0] * DIM)]
    assert answer(spark, rows + rows, clusters=4, rounds=3) == brute(rows + rows, DIM, 4, 3)
    few = rows[:3]
    assert answer(spark, few, clusters=8, rounds=3) == brute(few, DIM, 8, 3)
    df = spark.createDataFrame([(*r, "mine", "mine", "mine") for r in rows], "vec_id long, embedding array<double>, cluster string, whole string, cell string")
    assert sorted(map(tuple, T.cluster_vectors(df, dim=DIM, clusters=4, rounds=3).collect()), key=str) == brute(rows, DIM, 4, 3)
    none = T.cluster_vectors(df.limit(0), dim=DIM)
    assert none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and none.count() == 0


def test_wide_components(spark):
    """Beyond 64 bits: exact all the same, null where no long holds a distance; single precision; what is too wide is left out."""
    rng = np.random.default_rng(6)
    rows = grouped(5, 60) + [(100 + i, (rng.normal(size=DIM) * 10.0 ** rng.integers(0, 11)).tolist()) for i in range(60)]
    got = answer(spark, rows, clusters=6, rounds=4, shard_rows=16)
    assert got == brute(rows, DIM, 6, 4) and any(r[2] is None for r in got)
    single = [(i, [float(np.float32(x)) for x in v]) for i, v in grouped(8, 100)]
    assert answer(spark, single, kind="float", clusters=5, rounds=3) == brute(single, DIM, 5, 3)
    assert len(answer(spark, [(1, [1e30] * DIM), (2, [0.0] * DIM)], clusters=2)) == 1


def test_trees_hold_what_they_say():
    rng = np.random.default_rng(3)
    for x in (rng.normal(size=(500, DIM)), np.repeat(rng.integers(0, 4, (40, DIM)), 8, axis=0), np.zeros((20, DIM))):
        x = x.astype(np.float64)
        t = T.cover_tree(x)
        y = x[t.order]
        assert sorted(t.order) == list(range(len(x)))
        for node in range(len(t.start)):
            inside = y[t.start[node] : t.end[node]]
            d = np.sqrt(((inside - y[t.start[node]]) ** 2).sum(1))
            assert (d <= t.radius[node]).all()
            if t.children[node]:
                kids = np.arange(t.child[node], t.child[node] + t.children[node])
                assert t.start[kids[0]] == t.start[node] and t.end[kids[-1]] == t.end[node] and (t.start[kids[1:]] == t.end[kids[:-1]]).all()
                centres = y[t.start[kids]]
                apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2)) + np.eye(len(kids)) * 1e9
                assert (apart > d.max() / 2).all()
            else:
                assert len(inside) <= T.LEAF or d.max() == 0


def test_pairs_are_pruned():
    """Of vectors in tight groups nearly all are assigned as whole nodes."""
    rng = np.random.default_rng(1)
    of = rng.integers(0, 8, 1000)
    x = (rng.normal(size=(8, 64)) * 5000)[of] + rng.integers(-40, 40, (1000, 64))
    x = np.floor(x).astype(np.int64)
    t = T.cover_tree(x.astype(np.float64))
    y = x[t.order]
    starts = np.unique(of, return_index=True)[1]
    node, _, q, _ = T.walk(t, y.astype(np.float64), T.Centroids(x[starts].tolist()))
    assert (t.end[node] - t.start[node]).sum() >= 900 and len(q) <= 800
