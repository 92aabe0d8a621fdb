import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weaklabel.functions.ranking import cut_points, exact_quantiles, first_by_hash, hash_rank, highest, running_totals
from weaklabel.operators.split import kfold


def digest(i, seed):
    return hashlib.md5(f"{i}:{seed}".encode()).hexdigest()


@pytest.mark.parametrize("partitions", [1, 7])
def test_rank_equals_brute_force_in_a_hot_group(spark, partitions):
    rows = [(i, "hot" if i % 3 else f"g{i % 5}") for i in range(600)] + [(1000, None), (1001, None)]
    df = spark.createDataFrame(rows, "id long, g string").repartition(partitions)
    got = {r["id"]: (r["rank"], r["n"]) for r in hash_rank(df, "id", 5, within=["g"], total="n").collect()}
    for g in {g for _, g in rows}:
        ids = sorted([i for i, x in rows if x == g], key=lambda i: (digest(i, 5), i))
        assert [got[i] for i in ids] == [(pos + 1, len(ids)) for pos in range(len(ids))]


def test_lead_columns_come_first(spark):
    df = spark.range(200).withColumn("c", F.col("id") % 2)
    got = {r["id"]: r["rank"] for r in hash_rank(df, "id", 1, lead=["c"]).collect()}
    want = sorted(range(200), key=lambda i: (i % 2, digest(i, 1), i))
    assert [got[i] for i in want] == list(range(1, 201))


@pytest.mark.parametrize("n", [0, 1, 41, 300, 1000])
def test_first_by_hash_takes_exactly_n(spark, n):
    got = {r["id"] for r in first_by_hash(spark.range(300), "id", n, 9).collect()}
    assert got == set(sorted(range(300), key=lambda i: (digest(i, 9), i))[:n])


@pytest.mark.parametrize("k", [1, 7, 50, 199, 400])
def test_highest_with_ties_and_missing_scores(spark, k):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 0.5, 0.5, round(rng.random(), 2)])) for i in range(200)]
    got = {r["id"] for r in highest(spark.createDataFrame(rows, "id long, s double"), "s", "id", k).collect()}
    want = sorted(rows, key=lambda r: (-(r[1] if r[1] is not None else float("-inf")), r[0]))[:k]
    assert got == {i for i, _ in want}


def test_a_narrow_group_has_buckets_of_its_own(spark):
    rng = random.Random(2)
    rows = [(g, rng.random() * (1e-6 if g == 0 else 1.0)) for g in range(5) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g int, v double")
    cuts = {r["g"]: r["__cuts"] for r in cut_points(df, "v", ["g"]).collect()}
    for g, own in cuts.items():
        values = sorted(v for x, v in rows if x == g)
        depth = np.diff([0, *np.searchsorted(values, own), len(values)])
        assert len(own) > 40 and depth.max() < 6 * len(values) / len(own)


@pytest.mark.parametrize("n, k", [(103, 10), (9, 10), (40, 5), (7, 3)])
def test_fold_sizes_match_ntile(spark, n, k):
    got = [r["count"] for r in kfold(spark.range(n), "id", k).groupBy("fold").count().orderBy("fold").collect()]
    assert got == [len(part) for part in np.array_split(np.arange(n), k) if len(part)]


def test_folds_without_equal_sizes_need_no_shuffle(spark):
    df = kfold(spark.range(1000), "id", 4, equal=False)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r["fold"] for r in df.select("fold").distinct().collect()} == {1, 2, 3, 4}


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    rng = random.Random(3)
    rows = {(g, round(rng.random() ** 4, 3)): rng.randint(1, 9) for g in "ab" for _ in range(400)}
    df = spark.createDataFrame([(g, v, n) for (g, v), n in rows.items()], "g string, v double, n long")
    got = {(r["g"], r["v"]): (r["cum_n"], r["all_n"]) for r in running_totals(df, "v", ["n"], ["g"], descending, 8).collect()}
    for g in "ab":
        total, whole = 0, sum(n for (x, _), n in rows.items() if x == g)
        for v in sorted((v for x, v in rows if x == g), reverse=descending):
            total += rows[(g, v)]
            assert got[(g, v)] == (total, whole)


def test_quantiles_match_numpy_with_a_hot_value(spark):
    rng = np.random.default_rng(1)
    data = {"a": np.r_[np.zeros(500), rng.normal(size=701)], "b": rng.exponential(size=8), "c": np.array([3.5])}
    df = spark.createDataFrame([(g, float(x)) for g, xs in data.items() for x in xs], "g string, v double")
    probs = {"q1": 0.25, "q2": 0.5, "q3": 0.75, "q9": 0.9}
    for r in exact_quantiles(df, "v", probs, ["g"]).collect():
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.quantile(data[r["g"]], p))
