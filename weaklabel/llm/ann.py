"""Nearest neighbours by randomly rotated one-bit codes.

Each vector is taken relative to a centre, scaled to length one and turned by a random rotation; the signs of its
coordinates are its code. With the code go two numbers: the distance to the centre and the inner product of the turned
vector with the corner that its signs name. From these the inner product with a query, and so the distance, is estimated
without bias, with an error of at most ``spread`` * sqrt((1 - f^2) / f^2) / sqrt(d - 1) but for a tiny chance, f being that
inner product. In a block, a vector is reranked by its exact distance if the least distance that its bound allows is within
the k-th smallest of the largest distances that the bounds allow; so none is left out but where a bound fails.

The index is a table of blocks: ids, packed codes, the two numbers and the vectors themselves, in rows of some thousand
vectors, made where the rows are read. Queries are packed in blocks too; every index block meets every query block in an
equi-join on the block number, and hands on only k rows a query. The centre is the mean of a sample of ``SAMPLE`` vectors,
the only thing that is fitted. The vectors go along with the codes because the bounds of one bit a component leave many to
rerank: of random vectors of 64 components about half of all.

Distances are Euclidean, in double precision. Vectors of different length are never compared.

Defined cases: vectors that are null, all zero, or hold a null or non-finite component take no part, as queries or as
candidates; a null id takes no part; a repeated row of the same id and vector counts once; the vectors of one id that has
several are candidates and queries each, and the answer has the k nearest to any of the query's, an id once with its least
distance; a query's own id is no candidate; ties go to the smaller id; fewer candidates than k give all of them; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weaklabel.llm.common import written

SAMPLE = 10_000
QUERY_BLOCK = 1024
PAIRS = 1 << 16


def usable(vector: Column) -> Column:
    """Whether a vector has components, all finite, and not all zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(dimension: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dimension]).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, distance to the centre, and inner product of the turned unit vector with its corner."""
    away = vectors - centre
    norm = np.sqrt((away * away).sum(axis=1))
    unit = away @ turn.T / np.where(norm > 0, norm, 1)[:, None]
    return np.packbits(unit > 0, axis=1), norm, np.abs(unit).sum(axis=1) / np.sqrt(vectors.shape[1])


def bounds(codes, norms, fits, queries, centre, turn, spread) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest squared distances (queries x vectors) that codes and corrections allow."""
    d = len(centre)
    away = queries - centre
    length = np.sqrt((away * away).sum(axis=1))
    unit = away @ turn.T / np.where(length > 0, length, 1)[:, None]
    # the inner product with a corner is twice the sum over its set bits less the sum over all
    set_sum = unit @ np.unpackbits(codes, axis=1, count=d).T.astype(np.float64)
    f = np.where(fits > 0, fits, 1)
    guess = (2 * set_sum - unit.sum(axis=1)[:, None]) / np.sqrt(d) / f
    error = spread * np.sqrt(np.maximum(0, 1 - f * f)) / f / np.sqrt(max(d - 1, 1))
    base = length[:, None] ** 2 + norms[None, :] ** 2
    scale = 2 * length[:, None] * norms[None, :]
    return base - scale * np.minimum(guess + error, 1), base - scale * np.maximum(guess - error, -1)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, dimension)


def build_index(vectors: DataFrame, seed: int = 7) -> DataFrame:
    """Blocks of ``vectors`` (id, vector), in a written table."""
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    centres = {}
    for d in {len(r["vector"]) for r in sample}:
        centres[d] = np.mean([r["vector"] for r in sample if len(r["vector"]) == d], axis=0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                sizes = np.asarray(part.column("d"))
                rows = []
                for d in np.unique(sizes).tolist():
                    own = part.filter(pa.array(sizes == d))
                    x = _matrix(own.column("vector"), d)
                    centre = centres.get(d, np.zeros(d))
                    codes, norms, fits = encode(x, centre, rotation(d, seed))
                    rows.append((d, centre.tobytes(), np.asarray(own.column("id")).tobytes(), codes.tobytes(), norms.tobytes(), fits.tobytes(), x.tobytes()))
                yield pa.record_batch(
                    [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 7))],
                    names=["d", "centre", "ids", "codes", "norms", "fits", "vectors"],
                )

    blocks = vectors.select("id", "vector", F.size("vector").alias("d"))
    return written(blocks.mapInArrow(work, "d int, centre binary, ids binary, codes binary, norms binary, fits binary, vectors binary"), "one-bit-index")


def _search(k: int, spread: float, seed: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                d = batch.column("d")[r].as_py()
                read = lambda name, kind="<f8": np.frombuffer(batch.column(name)[r].as_py(), dtype=kind)  # noqa: B023, E731
                ids, norms, fits, centre = read("ids", "<i8"), read("norms"), read("fits"), read("centre")
                codes = read("codes", np.uint8).reshape(len(ids), -1)
                x = read("vectors").reshape(len(ids), d)
                members = batch.column("queries")[r]
                asked = np.asarray(members.values.field("id"))
                q = _matrix(members.values.field("vector"), d)
                least, most = bounds(codes, norms, fits, q, centre, rotation(d, seed), spread)
                own = asked[:, None] == ids[None, :]
                most[own] = np.inf
                n = min(k, len(ids))
                limit = np.partition(most, n - 1, axis=1)[:, n - 1]
                i, j = np.nonzero((least <= limit[:, None]) & ~own)
                exact = np.concatenate([np.sqrt(((x[j[a : a + PAIRS]] - q[i[a : a + PAIRS]]) ** 2).sum(axis=1)) for a in range(0, len(i), PAIRS)] or [np.zeros(0)])
                order = np.lexsort((ids[j], exact, i))
                i, j, exact = i[order], j[order], exact[order]
                first = np.searchsorted(i, np.arange(len(asked)))
                keep = np.arange(len(i)) - first[i] < k
                yield pa.record_batch([pa.array(asked[i[keep]]), pa.array(ids[j[keep]]), pa.array(exact[keep])], names=["query_id", "vec_id", "score"])

    return search


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, spread: float = 3.0, seed: int = 7, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score (distance) of the ``k`` nearest other rows of each row that ``is_query``."""
    chosen = vectors.withColumn("__query", F.coalesce(is_query, F.lit(False)))
    good = chosen.where(F.col(id_column).isNotNull() & usable(F.col(vector_column)))
    good = good.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector"), "__query")
    # repeated rows are told by two hashes; the vectors move once and are then read from a written table
    same = [F.xxhash64("vector"), F.xxhash64(F.lit(seed), "vector")]
    one = good.groupBy("id", *same).agg(F.first("vector").cast("array<double>").alias("vector"), F.max("__query").alias("__query"))
    good = written(one.select("id", "vector", "__query"), "one-bit-vectors")
    index = build_index(good.select("id", "vector"), seed)
    queries = good.where("__query").select("id", "vector", F.size("vector").alias("d"))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    number = F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")
    packed = queries.groupBy("d", number).agg(F.collect_list(F.struct("id", "vector")).alias("queries"))
    met = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(packed, ["d", "block"])
    # a row is much work for few bytes: as many parts as shuffles have, not as few as the bytes would fill
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = met.repartition(parts).mapInArrow(_search(k, spread, seed), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
