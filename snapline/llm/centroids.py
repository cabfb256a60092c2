"""Clusters around centroids: Lloyd's rounds with a vantage-point tree over the centroids.

In each round the driver builds the tree from the centroids (``clusters`` x ``dims`` numbers, the only thing broadcast)
and every task walks it for its vectors, best bound first. A node's vantage centroid splits the others by their distance
to it; what lies beyond the best distance found so far is left out, and what lies exactly at it is still visited, so
that ties go to the smaller number. All distances that decide are sums of whole squares; roots only prune, with room
for their rounding. A task hands on one count and one sum per cluster, not its vectors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship_code, written

#: Components up to this size keep every squared distance of up to 64 of them, and below, within 64 bits.
MOST = 1 << 27
#: Numbers that the open bounds of one step may take.
STEP = 1 << 21


class VantageTree:
    """Centroids as a tree: node i holds centroid ``point[i]``, those within ``near[i]`` below ``inner[i]``, those from
    ``far[i]`` on below ``outer[i]``; -1 where there is none."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = np.asarray(centroids, np.int64)
        self.point, self.near, self.far, self.inner, self.outer = [], [], [], [], []
        self._grow(list(range(len(self.centroids))))
        self.point, self.inner, self.outer = (np.array(x, np.int64) for x in (self.point, self.inner, self.outer))
        self.near, self.far = np.array(self.near, np.float64), np.array(self.far, np.float64)

    def _grow(self, members: list[int]) -> int:
        if not members:
            return -1
        node, (first, *rest) = len(self.point), members
        distance = {m: int(((self.centroids[m] - self.centroids[first]) ** 2).sum()) for m in rest}
        rest.sort(key=lambda m: (distance[m], m))
        half = (len(rest) + 1) // 2
        self.point.append(first)
        self.near.append(math.sqrt(distance[rest[half - 1]]) if half else 0.0)
        self.far.append(math.sqrt(distance[rest[half]]) if half < len(rest) else 0.0)
        self.inner.append(-1)
        self.outer.append(-1)
        self.inner[node] = self._grow(rest[:half])
        self.outer[node] = self._grow(rest[half:])
        return node

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest centroid and squared distance of each vector, and how many distances that took."""
        n = len(vectors)
        best, which, measured = np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64), 0
        bound = np.full((n, len(self.point)), np.inf)
        bound[:, 0] = 0.0
        rows = np.arange(n)
        while len(rows):
            node = bound[rows, :].argmin(1)
            low = bound[rows, node]
            reach = np.sqrt(best[rows].astype(np.float64))
            live = low <= reach + 1e-9 * (1 + reach)  # inclusive, with room for rounded roots
            live &= np.isfinite(low)
            rows, node, low = rows[live], node[live], low[live]
            if not len(rows):
                break
            bound[rows, node] = np.inf
            centre = self.point[node]
            squared = ((vectors[rows] - self.centroids[centre]) ** 2).sum(1)
            measured += len(rows)
            better = (squared < best[rows]) | ((squared == best[rows]) & (centre < which[rows]))
            best[rows[better]], which[rows[better]] = squared[better], centre[better]
            away = np.sqrt(squared.astype(np.float64))
            for child, gap in ((self.inner, away - self.near[node]), (self.outer, self.far[node] - away)):
                has = child[node] >= 0
                gap = gap - 1e-12 * (1 + away + self.near[node] + self.far[node])
                bound[rows[has], child[node[has]]] = np.maximum(low, gap)[has]
        return which, best, measured

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``nearest`` in steps of bounded memory."""
        size = max(1, STEP // max(len(self.point), vectors.shape[1]))
        parts = [self.nearest(vectors[a : a + size])[:2] for a in range(0, len(vectors), size)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def whole_vectors(vectors: DataFrame, key: str, column: str, dims: int, scale: int) -> DataFrame:
    """Columns _key and _x: little-endian 32-bit floor(scale * component) of the vectors that take part.

    Vectors that are null, of another length, or hold a null or non-finite component take no part. A finite component
    beyond ``MOST`` after scaling is an error that names the vector, since distances would leave 64 bits.
    """
    ship_code(vectors.sparkSession)
    rows = vectors.select(F.col(key).alias("_key"), F.col(column).cast("array<double>").alias("_v"))
    rows = rows.where(F.size("_v") == dims)
    kind = rows.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)  # null: NaN
            keep = np.isfinite(x).all(1)
            with np.errstate(over="ignore"):
                x = np.floor(x[keep] * scale)
            keys = batch.column("_key").filter(pa.array(keep))
            far = (np.abs(x) > MOST).any(1)
            if far.any():
                raise ValueError(f"vector {keys[int(far.argmax())].as_py()}: a component is beyond {MOST} after scaling")
            flat = x.astype("<i4").tobytes()
            cells = pa.array([flat[i : i + 4 * dims] for i in range(0, len(flat), 4 * dims)], pa.binary())
            yield pa.RecordBatch.from_arrays([keys, cells], ["_key", "_x"])

    return rows.mapInArrow(run, f"_key {kind}, _x binary")


def _numbers(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)


def first_centroids(whole: DataFrame, clusters: int, dims: int, seed: int) -> list[list[int]]:
    """The ``clusters`` vectors with the smallest sha256 of ``<seed>:<key>``, null keys last, ties by components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_key").cast("string")), 256)
    rows = whole.orderBy(order.asc_nulls_last(), "_x").select("_x").limit(clusters).collect()
    return [np.frombuffer(bytes(r[0]), "<i4").tolist() for r in rows]


def _sums(whole: DataFrame, tree, dims: int) -> DataFrame:
    """Columns cluster, place, total and n: per task one row for each cluster and component, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = tree.value
        counts = np.zeros(len(one.centroids), np.int64)
        totals = np.zeros((len(one.centroids), dims), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _numbers(batch.column("_x"), dims)
                which, _ = one.assign(x)
                counts += np.bincount(which, minlength=len(counts))
                order = np.argsort(which, kind="stable")
                found, starts = np.unique(which[order], return_index=True)
                totals[found] += np.add.reduceat(x[order], starts, axis=0)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(used, dims).astype(np.int32)),
                pa.array(np.tile(np.arange(dims, dtype=np.int32), len(used))),
                pa.array(totals[used].reshape(-1)),
                pa.array(np.repeat(counts[used], dims)),
            ],
            ["cluster", "place", "total", "n"],
        )

    parts = whole.select("_x").mapInArrow(run, "cluster int, place int, total long, n long")
    exact = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    return parts.groupBy("cluster", "place").agg(exact, F.sum("n").alias("n"))


def lloyd(
    spark: SparkSession, whole: DataFrame, centroids: list[list[int]], dims: int, rounds: int
) -> list[list[int]]:
    """The centroids after ``rounds`` rounds of assignment and exact floor(sum / count); empty ones stay.

    The driver gets ``clusters`` x ``dims`` sums a round, however many vectors there are.
    """
    for _ in range(rounds):
        tree = spark.sparkContext.broadcast(VantageTree(np.array(centroids, np.int64)))
        moved = [list(c) for c in centroids]
        for r in _sums(whole, tree, dims).collect():
            moved[r["cluster"]][r["place"]] = int(r["total"]) // r["n"]
        tree.unpersist()
        if moved == centroids:
            break  # further rounds would repeat this one
        centroids = moved
    return centroids


def cluster(
    vectors: DataFrame,
    clusters: int = 8,
    rounds: int = 10,
    dims: int = 64,
    scale: int = 1024,
    seed: int = 3,
    key: str = "vec_id",
    column: str = "embedding",
) -> DataFrame:
    """One row per vector that takes part: ``key``, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    See ``whole_vectors`` for those that take part, ``first_centroids`` for the start. Fewer vectors than ``clusters``
    give fewer clusters, none gives no rows. Equal distances go to the smaller number, repeated rows count as often as
    they come and a null key is kept; other columns are not read. The rounds run while the result is built; the whole
    numbers and the final assignment are written once to the scratch folder.
    """
    spark = vectors.sparkSession
    whole = written(whole_vectors(vectors, key, column, dims, scale), "centroids-whole")
    kind = whole.schema["_key"].dataType.simpleString()
    start = first_centroids(whole, clusters, dims, seed)
    facts = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not start:
        rows = whole.select(F.col("_key").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return rows.join(spark.createDataFrame([], facts), "cluster").select(key, *_RESULT)
    final = lloyd(spark, whole, start, dims, rounds)
    tree = spark.sparkContext.broadcast(VantageTree(np.array(final, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                which, squared = tree.value.assign(_numbers(batch.column("_x"), dims))
                arrays = [batch.column("_key"), pa.array(which.astype(np.int32)), pa.array(squared)]
                yield pa.RecordBatch.from_arrays(arrays, ["_key", "cluster", "distance"])

    assigned = written(whole.mapInArrow(run, f"_key {kind}, cluster int, distance long"), "centroids-assigned")
    total = F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")
    inertia = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(total).collect()}
    rows = [
        (c, own, sum(inertia.values()), hashlib.sha256(",".join(map(str, final[c])).encode()).hexdigest())
        for c, own in inertia.items()
    ]
    return assigned.join(spark.createDataFrame(rows, facts), "cluster").select(F.col("_key").alias(key), *_RESULT)


_RESULT = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
