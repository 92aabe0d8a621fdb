import numpy as np
import pytest
from pyspark.sql import functions as F

from weaklabel.llm import cross_polytope


def brute(rows, least):
    """Links, components and heads of all pairs; rows are told apart by place, as ids may repeat."""
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    key = [i if i is not None else -(2**63) for i, _ in rows]
    unit = [np.array(v, dtype=float) / np.abs(v).max() if g else None for (_, v), g in zip(rows, good)]
    cosine = lambda a, b: a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b))
    links = [[] for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            if good[a] and good[b] and len(unit[a]) == len(unit[b]) and cosine(unit[a], unit[b]) >= least:
                links[a].append(b)
                links[b].append(a)
    out = []
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        head = min(key[b] for b in seen)
        null = lambda x: None if x == -(2**63) else x
        out.append((rows[a][0], len(links[a]), null(head), key[a] == head))
    return sorted(out, key=repr)


def found(spark, rows, kind="double", least=0.9, **options):
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({"node": F.lit("x"), "key": F.lit(1), "n_links": F.lit(2)})
    return sorted((tuple(r) for r in cross_polytope.near_copies(frame, least, **options).collect()), key=repr)


def groups(rng, n, size, d, noise):
    rows = []
    for _ in range(n):
        centre = rng.standard_normal(d)
        rows += [centre + noise * rng.standard_normal(d) for _ in range(size)]
    return [(i, v.tolist()) for i, v in enumerate(rows)]


@pytest.mark.parametrize("tile", [1024, 8])
def test_tight_groups_equal_all_pairs(spark, tile):
    rows = groups(np.random.default_rng(1), 15, 20, 64, 0.1) + [(500 + i, v.tolist()) for i, v in enumerate(np.random.default_rng(2).standard_normal((50, 64)))]
    assert found(spark, rows, tile=tile) == brute(rows, 0.9)


def test_every_pair_counts_once_and_none_is_false(spark):
    # pairs at about the threshold: some may be missed, none may be invented or counted twice
    rows = groups(np.random.default_rng(4), 12, 20, 32, 0.33)
    want, got = {r[0]: r for r in brute(rows, 0.9)}, {r[0]: r for r in found(spark, rows)}
    assert all(got[i][1] <= want[i][1] for i in want)
    total, recalled = sum(r[1] for r in want.values()), sum(r[1] for r in got.values())
    assert total > 500 and recalled >= 0.9 * total


def test_exact_copies_of_one_vector(spark):
    rng = np.random.default_rng(5)
    same, other = rng.standard_normal(64).tolist(), rng.standard_normal(64).tolist()
    rows = [(i, same) for i in range(40)] + [(100 + i, (1.01 * np.array(same)).tolist()) for i in range(5)] + [(200, other)]
    assert found(spark, rows) == brute(rows, 0.9)


def test_odd_rows(spark):
    v = [1.0, 2.0, -3.0]
    rows = [(1, v), (1, v), (1, [-3.0, 1.0, 1.0]), (None, v), (2, None), (3, []), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 2.0]), (6, [float("nan"), 1.0, 1.0])]
    rows += [(7, [float("inf"), 1.0, 1.0]), (8, [1.0]), (9, [3.0]), (10, [-1.0]), (11, [1e200, 2e200, -3e200]), (12, [1e-200, 2e-200, -3e-200])]
    assert found(spark, rows) == brute(rows, 0.9)
    assert found(spark, []) == []


def test_single_precision_is_compared_in_double(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in groups(rng, 5, 10, 16, 0.1)]
    assert found(spark, rows, kind="float") == brute(rows, 0.9)


@pytest.mark.parametrize("functions", [1, 2, 3])
def test_recall_of_single_pairs(functions):
    rng = np.random.default_rng(functions)
    x = rng.standard_normal((1000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    away = rng.standard_normal((1000, 64))
    away -= (away * x).sum(axis=1)[:, None] * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * away / np.linalg.norm(away, axis=1)[:, None]
    hit = np.zeros(1000, dtype=bool)
    for t in range(cross_polytope.tables_for(functions)):
        a, b = (cross_polytope.keys(m, t, functions, cross_polytope.probes_for(functions), 11) for m in (x, y))
        hit |= (a == b[:, :1]).any(axis=1) | (b == a[:, :1]).any(axis=1)
    assert hit.mean() >= 0.95


def test_rotation_keeps_lengths_and_angles():
    x = np.random.default_rng(0).standard_normal((20, 32))
    turned = cross_polytope.rotate(x, (1, 2))
    assert np.allclose(turned @ turned.T, x @ x.T) and not np.allclose(turned, x)
