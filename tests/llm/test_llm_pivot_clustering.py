import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weaklabel.llm import pivot_clustering


def brute(rows, k, rounds, dimension, scale=64):
    """All distances of all vectors in plain integers."""
    good = lambda v: v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) and abs(x) < pivot_clustering.LARGEST / scale for x in v)
    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if good(v)]
    seeds = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), i, v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, _, v in seeds]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        where = [nearest(v)[1] for _, v in kept]
        for c in range(len(centroids)):
            own = [v for (_, v), w in zip(kept, where) if w == c]
            if own:
                centroids[c] = tuple(sum(x) // len(own) for x in zip(*own))
    placed = [(i, *nearest(v)) for i, v in kept]
    total = sum(d for _, d, _ in placed)
    sums = {c: sum(d for _, d, w in placed if w == c) for c in range(len(centroids))}
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    return sorted(((i, c, d, sums[c], total, digest(c)) for i, d, c in placed), key=repr)


def found(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"cluster": F.lit("x"), "id": F.lit(1), "v": F.lit(2)})
    return sorted((tuple(r)[:6] for r in pivot_clustering.cluster(frame, **options).collect()), key=repr)


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_equals_all_distances(spark, spread):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((5, 8))
    rows = [(i, (centres[i % 5] + spread * rng.standard_normal(8)).tolist()) for i in range(300)]
    rows += [(1000 + i, v) for i, (_, v) in enumerate(rows[:30])]  # ties
    options = {"k": 7, "rounds": 3, "dimension": 8}
    assert found(spark, rows, **options) == brute(rows, **options)


def test_odd_rows(spark):
    rows = [(1, [0.0, 0.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [float("inf"), 0.0]), (7, [1.5, -1.5]), (7, [1.5, -1.5])]
    rows += [(7, [9.0, 9.0]), (None, [2.0, 2.0]), (8, [1e12, 0.0]), (9, []), (10, [-0.01, 0.01])]
    options = {"k": 3, "rounds": 2, "dimension": 2}
    assert found(spark, rows, **options) == brute(rows, **options)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(i, [float(i), 0.0]) for i in range(3)]
    assert found(spark, rows, k=16, rounds=3, dimension=2) == brute(rows, 16, 3, 2)
    assert found(spark, [], k=16, rounds=3, dimension=2) == []
    assert found(spark, [(None, [1.0, 2.0])], k=16, rounds=1, dimension=2) == []


def test_a_cluster_that_loses_all_its_vectors_stays(spark):
    # equal starting vectors: all but the first of them never get a vector
    rows = [(i, [1.0, 1.0]) for i in range(20)] + [(99, [5.0, 5.0])]
    assert found(spark, rows, k=6, rounds=2, dimension=2) == brute(rows, 6, 2, 2)


def test_bounds_spare_exact_distances(spark):
    rng = np.random.default_rng(1)
    centres = 10 * rng.standard_normal((8, 16))
    rows = [(i, (centres[i % 8] + 0.1 * rng.standard_normal(16)).tolist()) for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = pivot_clustering.cluster(frame, k=16, rounds=3, dimension=16)
    assert out.agg(F.avg("n_exact")).first()[0] < 8, "half of the distances at most"
    assert found(spark, rows, k=16, rounds=3, dimension=16) == brute(rows, 16, 3, 16)
