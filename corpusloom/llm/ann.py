"""Nearest neighbours by stable projections, kd-trees and a chi-square stopping test.

Vectors are projected by a Gaussian matrix to a few dimensions m; for a pair at distance d the squared projected
distance over d**2 follows a chi-square law with m degrees. A query takes projected neighbours in rising order,
leaves of a kd-tree at a time, and verifies them on the original vectors. It stops when the next projected distance
exceeds r = d_k * sqrt(quantile), d_k being its k-th verified distance: a true neighbour has been seen with
at least that probability. m follows the intrinsic dimension of a sample: few projections tell near from far where it
is low, and more where it is high.

Distributed form: the top of the kd-tree is fitted on a bounded sample and cuts projected space into cells of about a
shard; rows of a larger cell (many equal vectors) are dealt to several shards. A shard is of bounded size and has a
kd-tree of its own. A query first searches one shard of its own cell for a bound on d_k, then all other shards of those
cells whose box of projections is within r. Queries go to a shard in blocks, so that no task has more than a shard and a
block.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from corpusloom.llm.common import Tables

#: Numbers of projections, and how many an intrinsic dimension of 1 takes.
FEWEST, MOST, PER_DIMENSION = 6, 16, 0.5
PROBABILITY = 0.9
SAMPLE_ROWS = 16_384
MAX_CELLS = 4096
#: Bytes of double vectors in a shard, and in a block of queries.
SHARD_BYTES = 8_000_000
LEAF = 64


def chi_square_quantile(p: float, degrees: int) -> float:
    """Of an even number of degrees, by bisection of the closed form."""
    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def intrinsic_dimension(points: np.ndarray, asks: int = 256, rows: int = 4096, k: int = 20) -> float:
    """Of a sample, by the maximum likelihood of neighbours' distances (their mean over the asked points); 1 without distances."""
    x = points[:rows]
    found = []
    for q in x[:asks]:
        d = np.sort(np.sqrt(((x - q) ** 2).sum(1)))[1 : k + 1]
        d = d[d > 0]
        if len(d) > 2 and d[-1] > d[0]:
            found.append(1 / np.log(d[-1] / d[:-1]).mean())
    return float(np.mean(found)) if found else 1.0


def projections_for(points: np.ndarray) -> int:
    """An even number of projections, for the sample's intrinsic dimension."""
    return int(min(max(2 * round(intrinsic_dimension(points) * PER_DIMENSION / 2), FEWEST), MOST))


def projection(dim: int, m: int, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dim, m))


def split_widest(points: np.ndarray, rows: np.ndarray) -> tuple[int, float] | None:
    """Axis of the largest extent and its median; null if all points are equal or all on one side."""
    part = points[rows]
    extent = part.max(0) - part.min(0)
    axis = int(extent.argmax())
    cut = float(np.median(part[:, axis]))
    if extent[axis] == 0:
        return None
    if not (part[:, axis] < cut).any():
        cut = float(part[part[:, axis] > cut, axis].min())
    return axis, cut


def top_tree(points: np.ndarray, cells: int) -> list[tuple]:
    """A kd-tree of at most so many cells as nodes (axis, cut, left, right) or (cell,)."""
    nodes: list[tuple] = [()]
    order = [(-len(points), 0, np.arange(len(points)))]
    done: list[int] = []
    while order:
        size, at, rows = heapq.heappop(order)
        cut = split_widest(points, rows) if len(order) + len(done) + 1 < cells and -size > 1 else None
        if cut is None:
            done.append(at)
            continue
        left = points[rows, cut[0]] < cut[1]
        nodes[at] = (*cut, len(nodes), len(nodes) + 1)
        for part in (rows[left], rows[~left]):
            nodes.append(())
            heapq.heappush(order, (-len(part), len(nodes) - 1, part))
    for k, at in enumerate(done):
        nodes[at] = (k,)
    return nodes


def cells_of(nodes: list[tuple], points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), np.int32)
    todo = [(0, np.arange(len(points)))]
    while todo:
        at, rows = todo.pop()
        if not len(rows):
            continue
        if len(nodes[at]) == 1:
            out[rows] = nodes[at][0]
            continue
        axis, cut, left, right = nodes[at]
        low = points[rows, axis] < cut
        todo += [(left, rows[low]), (right, rows[~low])]
    return out


class KdTree:
    """A kd-tree over the projections of a shard's rows, which are laid out leaf by leaf."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, places: np.ndarray, leaf: int = LEAF):
        leaves, todo = [], [np.arange(len(places))]
        while todo:
            rows = todo.pop()
            cut = split_widest(places, rows) if len(rows) > leaf else None
            if cut is None:
                # of equal places, too, a leaf has a bounded number of rows
                leaves += [rows[i : i + 16 * leaf] for i in range(0, len(rows), 16 * leaf)]
            else:
                low = places[rows, cut[0]] < cut[1]
                todo += [rows[low], rows[~low]]
        order = np.concatenate(leaves)
        self.ids, self.vectors, self.places = ids[order], vectors[order], places[order]
        self.squares = (self.vectors**2).sum(1)
        self.sizes = np.array([len(r) for r in leaves])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.low = np.minimum.reduceat(self.places, self.starts)
        self.high = np.maximum.reduceat(self.places, self.starts)
        self.verified = 0

    def nearest(self, query_id: int, vector: np.ndarray, place: np.ndarray, k: int, bound: float, quantile: float) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest rows found (distance, then id), given that k rows within bound are known elsewhere.

        Leaves come in rising order of distance, one, two, four and so on at a time. Products of vectors pick what may be
        among the k nearest; their distances are then worked out by differences.
        """
        gap = box_distance(self.low, self.high, place)
        order = np.argsort(gap, kind="stable")
        gap = gap[order]
        best_d, best_id = np.zeros(0), np.zeros(0, np.int64)
        at, step = 0, 1
        while at < len(order):
            most = min(bound, best_d[-1]) if len(best_d) == k else bound
            reach = ball(most, quantile, place)
            end = min(at + step, int(np.searchsorted(gap, reach, "right")))
            if end <= at:
                break
            leaves, at, step = order[at:end], end, 2 * step
            sizes = self.sizes[leaves]
            rows = np.repeat(self.starts[leaves] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            rows = rows[(((self.places[rows] - place) ** 2).sum(1) <= reach) & (self.ids[rows] != query_id)]
            if not len(rows):
                continue
            self.verified += len(rows)
            own = float(vector @ vector)
            about = self.squares[rows] - 2 * (self.vectors[rows] @ vector) + own
            slack = 1e-9 * (self.squares[rows] + own)  # far above the products' rounding
            limit = most**2
            if len(rows) > k:
                limit = min(limit, np.partition(about + slack, k - 1)[k - 1])
            rows = rows[about - slack <= limit]
            d = np.sqrt(((self.vectors[rows] - vector) ** 2).sum(1))
            best_d, best_id = np.concatenate([best_d, d]), np.concatenate([best_id, self.ids[rows]])
            first = np.lexsort((best_id, best_d))[:k]
            best_d, best_id = best_d[first], best_id[first]
        return best_d, best_id


def ball(distance: float, quantile: float, place: np.ndarray) -> float:
    """The square of the projected distance that counts as within; rounding of projections does not part equal vectors."""
    return distance**2 * quantile + 1e-12 * float(place @ place)


def box_distance(low: np.ndarray, high: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Squared distances of a point from boxes."""
    gap = np.maximum(low - place, 0) + np.maximum(place - high, 0)
    return (gap**2).sum(1)


def usable(vector: Column, dim: int) -> Column:
    """Vectors of that length with finite components only that are not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0)


def nearest_neighbours(
    rows: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", is_query: Column, k: int = 10, probability: float = PROBABILITY, projected: int | None = None,
    dim: int | None = None, shard_rows: int | None = None, query_block: int | None = None, sample_rows: int = SAMPLE_ROWS, max_cells: int = MAX_CELLS, seed: int = 5,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k nearest rows found, all rows if there are fewer.

    Nearness is Euclidean distance in double precision, ties go to the smaller id. A query's own id is no
    candidate. Null ids take no part, nor do vectors that are null, of another length than ``dim`` (default: the
    commonest), zero, or holding null or non-finite components. Of rows that repeat an id the smallest vector
    counts. Equal vectors under different ids are rows of their own. An empty table has an empty result. ``projected`` is
    an even number of projections, by default that of the sample's intrinsic dimension. Columns other than the two are
    not read, whatever their names.
    """
    spark = rows.sparkSession
    tables = Tables(spark)
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    if dim is None:
        common = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
        dim = common[0]["dim"] if common else 1
    shard_rows, query_block = (x or max(256, SHARD_BYTES // (8 * max(dim, 1))) for x in (shard_rows, query_block))
    single = isinstance(rows.schema["vector"].dataType.elementType, FloatType)
    kind = np.float32 if single else np.float64  # what vectors are kept in; all is worked out in double
    if not single:
        rows = rows.withColumn("vector", F.col("vector").cast("array<double>"))
    rows = tables.write(rows.where(usable(F.col("vector"), dim)).groupBy("vec_id").agg(F.min("vector").alias("vector")), "vectors")
    n = rows.count()
    picked = rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample_rows).select("vector").collect()
    sample = np.array([r[0] for r in picked], np.float64).reshape(-1, dim)
    m = projected or projections_for(sample)
    matrix, quantile = projection(dim, m, seed=seed), chi_square_quantile(probability, m)
    sample = sample @ matrix
    # A quarter more cells than shards are needed, so that few cells have two.
    tree = top_tree(sample, min(max_cells, -(-5 * n // (4 * shard_rows)), max(1, len(sample) // 4))) if len(sample) else [(0,)]
    tree = spark.sparkContext.broadcast(tree)  # at most 2 * max_cells nodes

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            p = x.astype(np.float64) @ matrix
            arrays = [b.column("vec_id"), pa.array([v.tobytes() for v in x.astype(kind)], pa.binary()), pa.array(cells_of(tree.value, p), pa.int32()), pa.array(p.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "vector", "cell", "at"])

    placed = tables.write(rows.mapInArrow(place, "vec_id long, vector binary, cell int, at array<double>"), "placed")
    at = [F.col("at")[i] for i in range(m)]
    boxes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.array(*[F.min(c) for c in at]).alias("low"), F.array(*[F.max(c) for c in at]).alias("high"))
    found = sorted(boxes.collect(), key=lambda r: r["cell"])  # at most max_cells rows
    shards = {r["cell"]: -(-r["n"] // shard_rows) for r in found}
    n_shards = F.element_at(F.create_map(*[F.lit(x) for pair in shards.items() for x in pair]), F.col("cell")) if found else F.lit(1)
    base = placed.select("vec_id", "vector", "cell", F.pmod(F.xxhash64("vec_id", F.lit(1)), n_shards).cast("int").alias("shard"))
    queries = placed.where(is_query).select("vec_id", "vector", "cell", F.pmod(F.xxhash64("vec_id", F.lit(3)), n_shards).cast("int").alias("home"))
    out = "query_id long, vec_id long, score double"

    def search(routed: DataFrame) -> DataFrame:
        """routed: query rows with cell, shard and bound."""
        load = routed.groupBy("cell", "shard").agg(F.ceil(F.count("*") / query_block).cast("int").alias("blocks"))
        asked = routed.join(load, ["cell", "shard"]).select("cell", "shard", F.pmod(F.xxhash64("vec_id", F.lit(2)), "blocks").cast("int").alias("part"), "vec_id", "vector", "bound")
        held = base.join(load, ["cell", "shard"]).select("cell", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), "vec_id", "vector", F.lit(None).cast("double").alias("bound"))
        key = F.xxhash64("cell", "shard", "part").alias("key")
        both = held.unionByName(asked).select(key, "vec_id", "vector", "bound")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
            for group in by_key(batches):
                asks = group.column("bound").is_valid().to_numpy()
                if asks.all():
                    continue
                ids, bounds = group.column("vec_id").to_numpy(), group.column("bound").to_numpy()
                vectors = np.frombuffer(b"".join(group.column("vector").to_pylist()), kind).reshape(len(group), -1).astype(np.float64)
                places = vectors @ matrix
                index = KdTree(ids[~asks], vectors[~asks], places[~asks])
                for part in np.array_split(np.flatnonzero(asks), -(-int(asks.sum()) // 1024) or 1):
                    result = [(ids[q], *index.nearest(ids[q], vectors[q], places[q], k, bounds[q], quantile)) for q in part]
                    if result:
                        columns = [np.repeat([r[0] for r in result], [len(r[1]) for r in result]), np.concatenate([r[2] for r in result]), np.concatenate([r[1] for r in result])]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

        return both.repartition("key").sortWithinPartitions("key").mapInArrow(run, out)

    infinite = F.lit(float("inf"))
    home = tables.write(search(queries.select("vec_id", "vector", "cell", F.col("home").alias("shard"), infinite.alias("bound"))), "home")
    bounds = home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("score")).otherwise(infinite).alias("bound"))
    routed = queries.join(bounds, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "vector", "cell", "home", F.coalesce("bound", infinite).alias("bound"))
    cells = spark.sparkContext.broadcast((np.array([r["cell"] for r in found], np.int32), np.array([r["low"] for r in found]).reshape(-1, m), np.array([r["high"] for r in found]).reshape(-1, m)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, low, high = cells.value
        for b in batches:
            places = np.frombuffer(b"".join(b.column("vector").to_pylist()), kind).reshape(-1, dim).astype(np.float64) @ matrix
            bound = b.column("bound").to_numpy()
            hit = [names[box_distance(low, high, p) <= ball(d, quantile, p)] for p, d in zip(places, bound, strict=True)]
            take = pa.array(np.repeat(np.arange(len(hit)), [len(h) for h in hit]))
            kept = [b.column(c).take(take) for c in ("vec_id", "vector", "bound", "cell", "home")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.concatenate([*hit, np.zeros(0, np.int32)]), pa.int32())], ["vec_id", "vector", "bound", "own", "home", "cell"])

    routed = routed.mapInArrow(route, "vec_id long, vector binary, bound double, own int, home int, cell int")
    # the own shard was searched to the end already
    routed = routed.withColumn("shard", F.explode(F.sequence(F.lit(0), n_shards - 1))).where("cell <> own OR shard <> home").select("vec_id", "vector", "bound", "cell", "shard")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    result = tables.write(home.unionByName(search(routed)), "found")
    tables.drop(result)
    return result.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one key after another, of batches sorted by key."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        keys = b.column("key").to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i == j:
                continue
            if held and last != keys[i]:
                yield pa.Table.from_batches(held)
                held = []
            last = keys[i]
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)
