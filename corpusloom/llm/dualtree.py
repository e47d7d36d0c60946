"""Centroid clustering: Lloyd's rounds by a pair of trees, exact in integers.

Vectors become integers and are dealt into shards of near ones, each with a cover tree: a node's points are within its radius
of its first point, its children's first points are more than half that radius apart and each point goes to the nearest of them.
Each round builds a tree of the same kind over the centroids and walks both: a pair of nodes is dropped once its lower
bound is above the upper bound of another pair of the same vectors, a node with a single centroid left is assigned whole (its
sum comes from prefix sums), and what is left at the leaves is compared exactly. Bounds are in floating point with a margin; all
sums and comparisons that decide are exact. A round is one pass over the stored shards; only a row for each centroid and
component reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.ann import by_key
from corpusloom.llm.common import Tables

#: Vectors of a shard, about; points of a leaf at most; vectors that shards are laid around; shards of a stored file.
SHARD_ROWS, LEAF, PIVOTS, SHARDS_PER_FILE = 1024, 8, 256, 128
#: Components below this are added and multiplied in 64 bits (for up to 128 of them), others as Python integers.
NARROW = 1 << 27
#: Vectors with a component of this size take no part: no distance to them fits a long.
WIDEST = float(1 << 42)
LONGEST_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Tree:
    """Nodes by level; a node holds the points from start to end in the tree's order, the first is its centre."""

    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    radius: np.ndarray
    child: np.ndarray  # of each node's children the first; they follow one another
    children: np.ndarray  # 0 for a leaf


def distances(x: np.ndarray) -> np.ndarray:
    """All distances, as good as floating point gives them; equal points are at 0."""
    square = (x * x).sum(1)
    d = square[:, None] + square[None, :] - 2.0 * (x @ x.T)
    # what cancels out is checked by the difference itself
    near = np.argwhere(d <= 1e-9 * (square[:, None] + square[None, :]))
    for part in np.array_split(near, -(-len(near) // 65536) or 1):
        d[part[:, 0], part[:, 1]] = ((x[part[:, 0]] - x[part[:, 1]]) ** 2).sum(1)
    return np.sqrt(np.maximum(d, 0))


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree over points (floating point rows), at least one."""
    d = distances(points)
    order = np.arange(len(points))
    start, end, radius, child, children = [0], [len(points)], [], [], []
    node = 0
    while node < len(start):
        a, b = start[node], end[node]
        here = order[a:b]
        far = d[here[0], here]
        r = float(far.max())
        # a little more than the largest distance, whatever its rounding
        radius.append(r * (1 + 1e-9) + (1e-6 if r else 0.0))
        child.append(len(start))
        if b - a <= leaf or r == 0:
            children.append(0)
        else:
            centres, rest = [here[0]], here[far > r / 2]
            while len(rest):
                centres.append(rest[0])
                rest = rest[d[rest[0], rest] > r / 2]
            nearest = d[np.ix_(centres, here)].argmin(0)
            by = np.argsort(nearest, kind="stable")
            cuts = np.searchsorted(nearest[by], np.arange(len(centres) + 1))
            moved = here[by]
            for c, i, j in zip(centres, cuts, cuts[1:], strict=False):
                at = i + int(np.flatnonzero(moved[i:j] == c)[0])
                moved[i], moved[at] = moved[at], moved[i]
            order[a:b] = moved
            start += (a + cuts[:-1]).tolist()
            end += (a + cuts[1:]).tolist()
            children.append(len(centres))
        node += 1
    kinds = (np.int32, np.int32, np.float64, np.int32, np.int32)
    return Tree(order, *[np.array(x, k) for x, k in zip((start, end, radius, child, children), kinds, strict=True)])


def expanded(node: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """For each of some nodes its children, or the node itself if it is a leaf; and which of the nodes each is of."""
    n = np.maximum(tree.children[node], 1)
    of = np.repeat(np.arange(len(node)), n)
    first = np.where(tree.children[node] > 0, tree.child[node], node)
    return first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n), of


class Centroids:
    """Centroids of one round, exact, with a tree; equal ones are known by the smallest number."""

    def __init__(self, rows: list[list[int]]):
        self.exact = rows
        self.narrow = all(abs(v) < NARROW for r in rows for v in r)
        self.whole = np.array(rows, np.int64 if self.narrow else object)
        self.points = np.array(rows, np.float64)
        self.tree = cover_tree(self.points, 1)
        t = self.tree
        self.number = np.array([t.order[a:b].min() for a, b in zip(t.start, t.end, strict=True)])  # of a leaf


def walk(tree: Tree, points: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Settled nodes with their centroids, then open units (nodes of a leaf's or a single place) with candidates, in pairs."""
    ct = centroids.tree
    settled: list[tuple[np.ndarray, np.ndarray]] = []
    open_: list[tuple[np.ndarray, np.ndarray]] = []
    q, r = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(q):
        d = np.sqrt(((points[tree.start[q]] - centroids.points[ct.order[ct.start[r]]]) ** 2).sum(1))
        both = tree.radius[q] + ct.radius[r]
        high = d + both
        heads = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        count = np.diff(np.r_[heads, len(q)])
        least = np.repeat(np.minimum.reduceat(high, heads), count)
        kept = d - both <= least * (1 + 1e-9) + 1e-6
        q, r = q[kept], r[kept]
        heads = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        count = np.repeat(np.diff(np.r_[heads, len(q)]), np.diff(np.r_[heads, len(q)]))
        single = (count == 1) & (ct.children[r] == 0)
        settled.append((q[single], centroids.number[r[single]]))
        leaf = ~single & (tree.children[q] == 0)
        lq, lr = q[leaf], r[leaf]
        while len(lr) and (ct.children[lr] > 0).any():
            lr, of = expanded(lr, ct)
            lq = lq[of]
        open_.append((lq, centroids.number[lr]))
        rest = ~single & ~leaf
        q, r = q[rest], r[rest]
        nq, of = expanded(q, tree)
        q, r = nq, r[of]
        nr, of = expanded(r, ct)
        q, r = q[of], nr
        by = np.argsort(q, kind="stable")
        q, r = q[by], r[by]
        # children of one place need no bounds: they are compared right away
        one = (tree.children[q] == 0) & (tree.radius[q] == 0) & (ct.children[r] == 0)
        done = one & ~np.isin(q, q[~one])
        open_.append((q[done], centroids.number[r[done]]))
        q, r = q[~done], r[~done]
    join = lambda pairs: tuple(np.concatenate(x).astype(np.int64) for x in zip(*pairs, strict=True))
    return (*join(settled), *join(open_))


def assign(tree: Tree, whole: np.ndarray, points: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of points (start, end) and the centroid of each; every point is in one range."""
    node, cluster, q, c = walk(tree, points, centroids)
    starts, ends, clusters = [tree.start[node]], [tree.end[node]], [cluster]
    if len(q):
        # a unit is one point, or a leaf of equal ones
        size = np.where(tree.radius[q] == 0, 1, tree.end[q] - tree.start[q])
        of = np.repeat(np.arange(len(q)), size)
        unit = tree.start[q][of] + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        stop = np.where(tree.radius[q][of] == 0, tree.end[q][of], unit + 1)
        c = c[of]
        if whole.dtype == np.int64 and centroids.narrow:
            d = np.concatenate([((whole[unit[i : i + 8192]] - centroids.whole[c[i : i + 8192]]) ** 2).sum(1) for i in range(0, len(unit), 8192)])
            by = np.lexsort((c, d, unit))
        else:
            d = [square(whole[u], centroids.exact[k]) for u, k in zip(unit, c, strict=True)]
            by = np.array(sorted(range(len(unit)), key=lambda i: (unit[i], d[i], c[i])))
        first = by[np.r_[True, unit[by][1:] != unit[by][:-1]]]
        starts.append(unit[first])
        ends.append(stop[first])
        clusters.append(c[first])
    return tuple(np.concatenate(x).astype(np.int64) for x in (starts, ends, clusters))


def square(a: np.ndarray, b: list[int]) -> int:
    """Squared distance in Python integers."""
    return sum((int(x) - y) ** 2 for x, y in zip(a, b, strict=True))


TREE = "ids array<long>, vectors array<long>, start array<int>, end array<int>, radius array<double>, child array<int>, children array<int>"


def read_trees(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, Tree, np.ndarray]]:
    """Ids, tree and vectors (in the tree's order) of each stored shard."""
    for b in batches:
        for i in range(b.num_rows):
            whole = b.column("vectors")[i].values.to_numpy().reshape(-1, dim)
            if np.abs(whole).max(initial=0) >= NARROW:
                whole = whole.astype(object)
            parts = [b.column(c)[i].values.to_numpy() for c in ("start", "end", "radius", "child", "children")]
            yield b.column("ids")[i].values, Tree(np.arange(len(whole)), *parts), whole


def prefix_sums(whole: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros((1, whole.shape[1]), whole.dtype), np.cumsum(whole, 0)])


def usable(vector: Column, dim: int) -> Column:
    """Vectors of that many components, all finite and within the widest."""
    return vector.isNotNull() & (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(WIDEST)))


def stored_trees(vectors: DataFrame, tables: Tables, dim: int, shard_rows: int, pivots: int) -> DataFrame:
    """A row for each shard of (vec_id, whole): its ids, vectors and cover tree."""
    picked = vectors.orderBy(F.xxhash64("vec_id", "whole"), "vec_id").limit(pivots).select("whole").collect()  # a bounded sample
    at = np.array([r["whole"] for r in picked], np.float64).reshape(-1, dim)
    half = (at * at).sum(1) / 2

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt = 0
        for b in batches:
            x = b.column("whole").flatten().to_numpy().reshape(-1, dim).astype(np.float64)
            cell = (x @ at.T - half).argmax(1) if len(x) else np.zeros(0)
            # rows are dealt in turn, so that many equal ones are too; stored, so that a task run again deals alike
            turn = np.arange(dealt, dealt + len(x))
            dealt += len(x)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("whole"), pa.array(cell, pa.int32()), pa.array(turn, pa.int64())], ["vec_id", "whole", "cell", "turn"])

    placed = tables.write(vectors.mapInArrow(place, "vec_id long, whole array<long>, cell int, turn long"), "placed")
    load = {r["cell"]: -(-r["n"] // shard_rows) for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most a row a pivot
    parts = F.element_at(F.create_map(*[F.lit(x) for pair in load.items() for x in pair]), F.col("cell"))
    keyed = placed.select(F.xxhash64("cell", F.pmod(F.xxhash64("turn"), parts)).alias("key"), "vec_id", "whole")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches):
            x = group.column("whole").combine_chunks().flatten().to_numpy().reshape(-1, dim)
            t = cover_tree(x.astype(np.float64))
            ids = group.column("vec_id").combine_chunks().take(pa.array(t.order))
            kinds = [pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
            arrays = [ids, pa.array(x[t.order].reshape(-1)), *[pa.array(v, k) for v, k in zip((t.start, t.end, t.radius, t.child, t.children), kinds, strict=True)]]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in arrays]
            yield pa.RecordBatch.from_arrays(lists, ["ids", "vectors", "start", "end", "radius", "child", "children"])

    return tables.write(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(build, TREE), "trees", per_file=SHARDS_PER_FILE)


def summed(centroids: Centroids, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One round's step: members and component sums of each centroid, over all of a task's shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros((len(centroids.exact), dim), object), np.zeros(len(centroids.exact), np.int64)
        for _, tree, whole in read_trees(batches, dim):
            start, end, cluster = assign(tree, whole, whole.astype(np.float64), centroids)
            prefix = prefix_sums(whole)
            by = np.argsort(cluster, kind="stable")
            present, heads = np.unique(cluster[by], return_index=True)
            totals[present] += np.add.reduceat(prefix[end[by]] - prefix[start[by]], heads, axis=0).astype(object)
            np.add.at(counts, cluster, end - start)
        some = np.flatnonzero(counts)
        columns = [np.repeat(some, dim), np.tile(np.arange(dim), len(some)), [int(v) for v in totals[some].reshape(-1)], np.repeat(counts[some], dim)]
        kinds = [pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["cluster", "at", "total", "n"])

    return run


def labelled(centroids: Centroids, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The last step: every vector's cluster and squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree, whole in read_trees(batches, dim):
            start, end, cluster = assign(tree, whole, whole.astype(np.float64), centroids)
            of = np.zeros(len(whole), np.int64)
            by = np.argsort(start)
            of[:] = np.repeat(cluster[by], (end - start)[by])  # ranges cover all points, each once
            if whole.dtype == np.int64 and centroids.narrow:
                d = pa.array(((whole - centroids.whole[of]) ** 2).sum(1), pa.int64())
            else:
                exact = [square(x, centroids.exact[c]) for x, c in zip(whole, of, strict=True)]
                d = pa.array([v if v <= LONGEST_LONG else None for v in exact], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(of, pa.int32()), d], ["vec_id", "cluster", "distance"])

    return run


def cluster_vectors(
    rows: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", dim: int, clusters: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3, shard_rows: int = SHARD_ROWS, pivots: int = PIVOTS
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector after so many rounds of Lloyd.

    Vectors take part that have ``dim`` components, none null, not finite or of a size of 2^42 or more (no distance to
    these fits a long); each component x counts as floor(scale * x). Centroids start as the vectors of the smallest sha256 of
    ``seed:vec_id``, a null id as nothing after the colon, rows of one id by their components; fewer vectors than clusters
    make fewer centroids. Each round assigns every vector to the nearest centroid, ties to the smaller number, and puts
    every centroid that has vectors at their componentwise floor(sum / count). Then all are assigned once more.
    distance is squared; a distance or sum that no long holds is null. Repeated rows and ids are rows of their own. An
    empty table has an empty result. Columns other than the two are not read, whatever their names.
    """
    tables = Tables(rows.sparkSession)
    whole = F.transform("vector", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")).alias("whole")
    read = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    vectors = tables.write(read.where(usable(F.col("vector"), dim)).select("vec_id", whole), "integers")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    at = [list(r["whole"]) for r in vectors.orderBy(digest, "whole").limit(clusters).select("whole").collect()]
    if not at:
        tables.drop()
        return rows.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    trees = stored_trees(vectors, tables, dim, shard_rows, pivots)
    for _ in range(rounds):
        sums = trees.mapInArrow(summed(Centroids(at), dim), "cluster int, at int, total decimal(38,0), n long").groupBy("cluster", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        moved = [list(r) for r in at]
        for r in sums.collect():  # a row for each centroid and component
            moved[r["cluster"]][r["at"]] = int(r["total"]) // r["n"]
        if moved == at:
            break  # what does not move stays where it is
        at = moved
    found = tables.write(trees.mapInArrow(labelled(Centroids(at), dim), "vec_id long, cluster int, distance long"), "assigned")
    whole_sum = F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)"))).alias("d")
    inertia = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(whole_sum).collect()}  # a row a centroid
    fits = lambda d: F.lit(None if d is None or d > LONGEST_LONG else int(d)).cast("long")
    by_cluster = lambda value: F.element_at(F.create_map(*[x for c in inertia for x in (F.lit(c), value(c))]), F.col("cluster"))
    total = None if None in inertia.values() else sum(inertia.values())
    sha = by_cluster(lambda c: F.lit(hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest()))
    tables.drop(found)
    return found.select("vec_id", "cluster", "distance", by_cluster(lambda c: fits(inertia[c])).alias("cluster_inertia"), fits(total).alias("inertia"), sha.alias("centroid_sha256"))
