"""One-bit neighbours against brute force, and their bounds."""

import numpy as np
from pyspark.sql import functions as F

from weaklabel.llm.ann import bounds, encode, nearest, rotation

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in good:
        if i % 100 == 0:
            near = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), j) for j, w in good if j != i and len(w) == len(v))
            out[i] = near[:k]
    return out


def ours(frame, k, **more):
    out = {}
    for r in sorted(nearest(frame, F.col("vec_id") % 100 == 0, k, **more).collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
    return out


def test_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    plain = [(r.vec_id, r.embedding) for r in rows.collect()]
    got, want = ours(rows, 10), brute(plain, 10)
    assert set(got) == {i for i, near in want.items() if near}
    hits = sum(len({j for _, j in got[i]} & {j for _, j in near}) for i, near in want.items())
    assert hits >= 0.99 * sum(map(len, want.values()))
    for i, near in got.items():
        exact = {j: d for d, j in brute(plain, 10_000)[i]} if i == 0 else None
        assert near == sorted(near) and (exact is None or all(abs(exact[j] - d) < 1e-9 for d, j in near))


def test_bounds_hold():
    draw = np.random.default_rng(3)
    x, q, centre = draw.standard_normal((3000, 48)), draw.standard_normal((20, 48)), draw.standard_normal(48) * 0.1
    turn = rotation(48, 7)
    assert np.allclose(turn @ turn.T, np.eye(48))
    least, most = bounds(*encode(x, centre, turn), q, centre, turn, 3.0)
    true = ((q[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    assert ((least <= true + 1e-9) & (true <= most + 1e-9)).mean() > 0.995


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [3.0, 0.0]), (9, [1.0, 0.0, 5.0]), (None, [1.0, 1.0]), (100, [2.0, 0.0]), (100, [2.0, 0.0]), (200, [])]
    got = ours(spark.createDataFrame(rows, SCHEMA).repartition(4), 3)
    assert got == brute(rows, 3) == {0: [(0.0, 1), (0.0, 2), (1.0, 100)], 100: [(1.0, 0), (1.0, 1), (1.0, 2)]}
    assert ours(spark.createDataFrame([], SCHEMA), 3) == {}
    assert ours(spark.createDataFrame([(0, [1.0])], SCHEMA), 3) == {}
    odd = spark.createDataFrame([(0, [1.0], 1, "x"), (1, [2.0], 2, "y")], "vec_id long, embedding array<double>, id long, vector string")
    assert ours(odd, 3) == {0: [(1.0, 1)]}


def test_one_id_with_two_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 5.0]), (1, [1.0, 0.5]), (2, [0.0, 5.5]), (2, [1.0, 0.25]), (3, [9.0, 9.0])]
    assert ours(spark.createDataFrame(rows, SCHEMA), 2) == {0: [(0.25, 2), (0.5, 1)]}
