"""Exact top-k search with a vector-approximation file.

Vectors are cut to cells of equal width in each component, a byte each, and stored in blocks. A scan of the cells gives
every candidate an upper and a lower bound of its inner product with a query; only candidates whose upper bound reaches
the k-th lower bound go on. Exact vectors are then read in two rounds, from the highest upper bounds down: the first gives
each query a k-th score, the second reads only what may still reach it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_code, written

#: Vectors in a block of cells, blocks that a task scans together, and queries in a block.
BLOCK, TOGETHER, QUERIES = 4096, 16, 512
#: Candidates read in the first round, times k.
FIRST = 2


def whole_numbers(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """Columns _row, _key, dim and x: floor(scale * component) as little-endian 32-bit whole numbers.

    Vectors that are null or hold a null or non-finite component are left out. A number beyond 32 bits is an error, so
    that no vector goes missing without a sign.
    """
    ship_code(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            keys, dims, xs = [], [], []
            for k, v in zip(batch.column("_key").to_pylist(), batch.column("_vector").to_pylist(), strict=True):
                if v is None or any(c is None for c in v):
                    continue
                x = np.floor(np.array(v, np.float64) * scale)
                if not np.isfinite(np.array(v, np.float64)).all():
                    continue
                if not (np.abs(x) < 1 << 31).all():
                    raise OverflowError(f"the vector of key {k} holds a component of {1 << 31} / {scale} or more in size")
                keys.append(k)
                dims.append(len(v))
                xs.append(x.astype("<i4").tobytes())
            rows = pa.array(range(at, at + len(keys)), pa.int64())
            at += len(keys)
            yield pa.RecordBatch.from_arrays(
                [rows, pa.array(keys, pa.int64()), pa.array(dims, pa.int32()), pa.array(xs, pa.binary())],
                ["_row", "_key", "dim", "x"],
            )

    plain = vectors.select(F.col(key).cast("long").alias("_key"), F.col(vector).cast("array<double>").alias("_vector"))
    return written(plain.mapInArrow(run, "_row long, _key long, dim int, x binary"), "topk-vectors")


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, exact: in floating point where all sums stay below 2^53, else in whole numbers."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _blocks(vectors: DataFrame, most: int, shift: int | None) -> DataFrame:
    """Blocks of at most ``most`` vectors of one dimension: block, dim, rows and x, which are cells of a byte if
    ``shift`` says how wide, else the whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {}

        def out(dim: int) -> pa.RecordBatch:
            nonlocal number
            rows, xs = zip(*held.pop(dim), strict=True)
            x = b"".join(xs)
            if shift is not None:
                x = (np.frombuffer(x, "<i4") >> shift).astype(np.int8).tobytes()
            number += 1
            arrays = [
                pa.array([number], pa.int64()),
                pa.array([dim], pa.int32()),
                pa.array([np.array(rows, "<i8").tobytes()], pa.binary()),
                pa.array([x], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(arrays, ["block", "dim", "rows", "x"])

        for batch in batches:
            for row, dim, x in zip(*(batch.column(c).to_pylist() for c in ("_row", "dim", "x")), strict=True):
                held.setdefault(dim, []).append((row, x))
                if len(held[dim]) == most:
                    yield out(dim)
        for dim in list(held):
            yield out(dim)

    return vectors.mapInArrow(run, "block long, dim int, rows binary, x binary")


def scan(queries: pd.DataFrame, blocks: pd.DataFrame, shift: int, k: int) -> pd.DataFrame:
    """Candidates of the queries in these blocks whose upper bound reaches the k-th lower bound found here."""
    found = []
    width = (1 << shift) - 1
    for _, q in queries.iterrows():
        dim = int(q["dim"])
        same = blocks[blocks["dim"] == dim]
        if not len(same):
            continue
        q_rows = np.frombuffer(q["rows"], "<i8")
        x = np.frombuffer(q["x"], "<i4").reshape(len(q_rows), dim).astype(np.int64)
        rows = np.concatenate([np.frombuffer(r, "<i8") for r in same["rows"]])
        uppers, lowers, whose, who = [], [], [], []
        at = 0
        for r, cells in zip(same["rows"], same["x"], strict=True):
            n = len(r) // 8
            low = product(x, np.frombuffer(cells, np.int8).reshape(n, dim).astype(np.int64) << shift)
            own = q_rows[:, None] == rows[None, at : at + n]
            upper = low + (width * np.maximum(x, 0).sum(1))[:, None]
            lower = low + (width * np.minimum(x, 0).sum(1))[:, None]
            lower[own] = np.iinfo(np.int64).min
            if n > k:
                least = np.partition(lower, n - k, 1)[:, n - k]
                stays = (upper >= least[:, None]) & ~own
            else:
                stays = ~own
            a, b = np.nonzero(stays)
            whose.append(q_rows[a])
            who.append(rows[at + b])
            uppers.append(upper[a, b])
            lowers.append(lower[a, b])
            at += n
        part = pd.DataFrame(
            {"q": np.concatenate(whose), "_row": np.concatenate(who), "upper": np.concatenate(uppers), "lower": np.concatenate(lowers)}
        )
        found.append(reach(part, k))
    return pd.concat(found) if found else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("q", "_row", "upper", "lower")})


def reach(part: pd.DataFrame, k: int) -> pd.DataFrame:
    """Rows whose upper bound reaches the k-th lower bound of their query."""
    rank = part.groupby("q")["lower"].rank(method="first", ascending=False)
    least = part[rank == k].set_index("q")["lower"]
    return part[part["upper"] >= part["q"].map(least).fillna(-math.inf)]


def best_of(rows: DataFrame, k: int, value: str, ties: list) -> DataFrame:
    """The k rows of each query with the highest ``value``; each task cuts its own before the shuffle."""
    order = Window.partitionBy("q").orderBy(F.col(value).desc(), *ties)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def still_reaching(rows: DataFrame, scored: DataFrame, k: int, value: str) -> DataFrame:
    """Rows whose upper bound reaches the k-th highest ``value`` of their query in ``scored``; all where it has fewer."""
    least = best_of(scored.select("q", value), k, value, []).groupBy("q").agg(F.min(value).alias("_least"), F.count("*").alias("_n"))
    met = rows.join(least, "q", "left")
    return met.where(F.col("_n").isNull() | (F.col("_n") < k) | (F.col("upper") >= F.col("_least"))).drop("_least", "_n")


def exact_scores(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Columns q, _row, _key and score for pairs of a query's row and a candidate's, read with their exact vectors."""
    own = vectors.select(F.col("_row").alias("q"), F.col("x").alias("qx"))
    met = pairs.select("q", "_row").join(vectors.select("_row", "_key", "x"), "_row").join(own, "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, qs = batch.column("x").to_pylist(), batch.column("qx").to_pylist()
            scores = np.zeros(len(xs), np.int64)
            sizes = np.fromiter(map(len, xs), np.int64, len(xs))
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                a, b = (np.frombuffer(b"".join(v[i] for i in at), "<i4").reshape(len(at), -1).astype(np.int64) for v in (xs, qs))
                if size and float(np.abs(a).max()) * float(np.abs(b).max()) * (size / 4) >= 2**63:
                    raise OverflowError("an inner product may leave 64 bits")
                scores[at] = (a * b).sum(1)
            arrays = [batch.column(c) for c in ("q", "_row", "_key")] + [pa.array(scores)]
            yield pa.RecordBatch.from_arrays(arrays, ["q", "_row", "_key", "score"])

    columns = met.select("q", "_row", "_key", "x", "qx")
    return columns.mapInArrow(run, "q long, _row long, _key long, score long")


def search(
    vectors: DataFrame,
    every: int = 50,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: int = 256,
    bits: int = 8,
) -> DataFrame:
    """Columns query_id, rank, vec_id, score: the k highest inner products of every query with all other rows.

    Queries are the rows whose key is divisible by ``every``. Ties go to the smaller key, then to the earlier row; rows
    without a key come last. Vectors of another dimension are no candidates. Rows that repeat are rows of their own, and
    a query's equals are found like any other row. Of rows with one vector only the k + 1 that ties prefer are kept as
    candidates, as no more of them can be among k results. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    all_rows = whole_numbers(vectors, key, vector, scale)
    if all_rows.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    spread = all_rows.mapInArrow(_largest, "most long").agg(F.max("most")).first()[0]
    shift = max(0, int(spread).bit_length() + 1 - bits)
    first = Window.partitionBy("x", "dim").orderBy(F.col("_key").asc_nulls_last(), "_row")
    kept = all_rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1).drop("_n")
    blocks = written(_blocks(kept, BLOCK, shift), "topk-cells")
    asked = all_rows.where(F.col("_key") % every == 0)
    query_blocks = written(_blocks(asked, QUERIES, None).withColumnRenamed("block", "query_block"), "topk-queries")
    parts = max(1, math.ceil(blocks.count() / TOGETHER))
    numbers = F.sequence(F.lit(0), F.lit(parts - 1))
    # Every block of queries meets every block of cells of its dimension: the stated query set, in blocks.
    dims = written(query_blocks.select("query_block", "dim"), "topk-dims")
    left = query_blocks.withColumn("part", F.explode(numbers))
    right = blocks.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int")).join(dims, "dim")
    schema = "q long, _row long, upper long, lower long"
    found = (
        left.groupBy("query_block", "part")
        .cogroup(right.groupBy("query_block", "part"))
        .applyInPandas(lambda a, b: scan(a, b, shift, k), schema)
    )
    found = written(found, "topk-bounds")
    reached = written(still_reaching(found, found, k, "lower"), "topk-reached")
    first = best_of(reached, FIRST * k, "upper", ["_row"]).select("q", "_row")
    read = written(exact_scores(first, all_rows), "topk-first")
    rest = still_reaching(reached, read, k, "score").join(read, ["q", "_row"], "left_anti")
    scored = read.unionByName(exact_scores(rest, all_rows))
    names = asked.select(F.col("_row").alias("q"), F.col("_key").alias("query_id"))
    best = best_of(scored, k, "score", [F.col("_key").asc_nulls_last(), F.col("_row").asc()])
    return best.join(names, "q").select("query_id", "rank", F.col("_key").alias("vec_id"), "score")


def _largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    most = 0
    for batch in batches:
        for x in batch.column("x").to_pylist():
            if x:
                most = max(most, int(np.abs(np.frombuffer(x, "<i4").astype(np.int64)).max()))
    yield pa.RecordBatch.from_arrays([pa.array([most], pa.int64())], ["most"])
