"""Centroid clustering over a LAESA pivot table, in exact integers.

Each vector's components become integers floor(64 x). Its distances to a few fixed pivots are worked out once and stored
with it, in blocks of some thousand vectors. In a round the distances from all centroids to the pivots are small numbers
that go to every task; by the triangle inequality |d(x, p) - d(c, p)| bounds the distance from vector x to centroid c from
below, for every pivot p. A vector's centroid of the least bound gets its exact distance first; of the others only those
whose bound is within that distance do. So results are those of comparing all, ties included.

The pivots are the starting centroids and never move. Centroids are ``k`` rows; sums per cluster are combined before they
are shuffled, so a cluster with a third of all rows is no hot group, and the driver sees k rows a round.

Defined cases: vectors that are null, of another length, or hold a null, a non-finite component or one whose integer is
2^27 or more (squared distances would not be longs) take no part; a zero vector does; a vector with a null id is clustered
but is no starting centroid, and comes back with a null id; every repeated row counts and comes back; of rows that share an
id, one of the smallest components in order starts; fewer rows than ``k`` give fewer centroids; an empty table, or one with
no usable id, gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weaklabel.llm.common import written

BLOCK = 4096
LARGEST = 1 << 27


def integers(vectors: DataFrame, dimension: int, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """id and v (array of longs) of the vectors that take part."""
    x = F.col(vector_column).cast("array<double>")
    good = (F.size(x) == dimension) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST / scale))
    rows = vectors.where(F.coalesce(good, F.lit(False)))
    return rows.select(F.col(id_column).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows of ``x`` and ``y``, pair by pair, as exact longs."""
    away = x.astype(np.int64) - y
    return np.einsum("ij,ij->i", away, away)


def pivot_table(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Blocks of ids, integer vectors and distances to all pivots, in a written table."""
    d = pivots.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                v = np.asarray(part.column("v").flatten()).reshape(-1, d).astype(np.int32)
                far = np.sqrt(np.stack([_squares(v, p) for p in pivots], axis=1).astype(np.float64))
                yield pa.record_batch([pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([v.tobytes()], pa.binary()), pa.array([far.tobytes()], pa.binary())], names=["ids", "v", "far"])

    return written(rows.mapInArrow(work, "ids array<long>, v binary, far binary"), "pivot-table")


def assign(v: np.ndarray, far: np.ndarray, centroids: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number of equals), its squared distance, and how many exact distances it took."""
    least = np.zeros((len(v), len(centroids)))
    for p in range(far.shape[1]):
        np.maximum(least, np.abs(far[:, p, None] - to_pivots[None, :, p]), out=least)
    rows = np.arange(len(v))
    guess = least.argmin(axis=1)
    exact = np.full(least.shape, np.iinfo(np.int64).max)
    exact[rows, guess] = _squares(v, centroids[guess])
    # square roots are right to one unit in 2^52: the slack keeps every centroid that may be as near
    reach = np.sqrt(exact[rows, guess].astype(np.float64)) * (1 + 1e-9) + 1e-6
    i, j = np.nonzero(least <= reach[:, None])
    open_ = j != guess[i]
    i, j = i[open_], j[open_]
    exact[i, j] = _squares(v[i], centroids[j])
    nearest = exact.argmin(axis=1)
    return nearest, exact[rows, nearest], 1 + np.bincount(i, minlength=len(v))


def _blocks(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, pivots: np.ndarray) -> Iterator[tuple]:
    d = centroids.shape[1]
    to_pivots = np.sqrt(np.stack([_squares(centroids, p) for p in pivots], axis=1).astype(np.float64))
    for batch in batches:
        for r in range(batch.num_rows):
            v = np.frombuffer(batch.column("v")[r].as_py(), dtype=np.int32).reshape(-1, d)
            far = np.frombuffer(batch.column("far")[r].as_py(), dtype=np.float64).reshape(len(v), -1)
            yield batch.column("ids")[r].values, v, *assign(v, far, centroids, to_pivots)


def cluster(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dimension: int = 64, scale: int = 64, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 and n_exact of each vector that takes part.

    ``n_exact`` is the number of exact distances that the last assignment worked out for the vector, of ``k``.
    """
    spark = vectors.sparkSession
    rows = integers(vectors, dimension, scale, id_column, vector_column)
    order = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    start = rows.where(F.col("id").isNotNull()).orderBy(order, "id", "v").limit(k).collect()
    if not start:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, n_exact int")
    centroids = np.array([r["v"] for r in start], dtype=np.int64)
    pivots = np.unique(centroids, axis=0)
    table = pivot_table(rows, pivots)

    def sums(centroids: np.ndarray):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros(centroids.shape, dtype=np.int64), np.zeros(len(centroids), dtype=np.int64)
            for _ids, v, nearest, _distance, _n in _blocks(batches, centroids, pivots):
                for c in np.unique(nearest):
                    own = v[nearest == c]
                    total[c] += own.sum(axis=0, dtype=np.int64)
                    count[c] += len(own)
            held = np.flatnonzero(count)
            yield pa.record_batch([pa.array(held, pa.int64()), pa.array(count[held]), pa.array(total[held].tolist(), pa.list_(pa.int64()))], names=["c", "n", "s"])

        return work

    for _ in range(rounds):
        parts = table.mapInArrow(sums(centroids), "c long, n long, s array<long>")
        found = parts.groupBy("c").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(dimension)]).alias("s")).collect()
        centroids = centroids.copy()
        for r in found:  # an empty cluster has no row and stays where it is
            centroids[r["c"]] = [s // r["n"] for s in r["s"]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _v, nearest, distance, n in _blocks(batches, centroids, pivots):
            yield pa.record_batch([ids, pa.array(nearest, pa.int32()), pa.array(distance), pa.array(n, pa.int32())], names=["vec_id", "cluster", "distance", "n_exact"])

    placed = written(table.mapInArrow(work, "vec_id long, cluster int, distance long, n_exact int"), "pivot-clusters")
    inertia = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of_cluster = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1)
    return placed.select(
        "vec_id",
        "cluster",
        "distance",
        of_cluster([inertia.get(c, 0) for c in range(len(centroids))]).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        of_cluster(digests).alias("centroid_sha256"),
        "n_exact",
    )
