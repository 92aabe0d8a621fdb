import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weaklabel.operators import votes as V

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, *v, i % 2) for i, v in enumerate(itertools.product([-1, 0, 1], repeat=3))]
    return spark.createDataFrame(rows, "id int, a int, b int, c int, gold int").persist()


def test_majority(table):
    for r in V.with_majority(table, NAMES).collect():
        case, control = [r[n] for n in NAMES].count(1), [r[n] for n in NAMES].count(0)
        assert r["prob_case"] == (1.0 if case > control else 0.0 if control > case else 0.5)
        assert r["prob_case"] + r["prob_control"] == 1.0


def test_summary_equals_brute_force(table):
    rows = [r.asDict() for r in table.collect()]
    got = {r["rule"]: r for r in V.rule_summary(table, NAMES, gold="gold").collect()}
    for n in NAMES:
        others = [m for m in NAMES if m != n]
        spoke = [r for r in rows if r[n] != -1]
        overlaps = [r for r in spoke if any(r[m] != -1 for m in others)]
        conflicts = [r for r in spoke if any(r[m] not in (-1, r[n]) for m in others)]
        right = [r for r in spoke if r[n] == r["gold"]]
        assert got[n]["polarity"] == "0,1"
        assert got[n]["coverage"] == pytest.approx(len(spoke) / 27)
        assert got[n]["overlaps"] == pytest.approx(len(overlaps) / 27)
        assert got[n]["conflicts"] == pytest.approx(len(conflicts) / 27)
        assert (got[n]["correct"], got[n]["incorrect"]) == (len(right), len(spoke) - len(right))
        assert got[n]["emp_acc"] == pytest.approx(len(right) / len(spoke))
        assert got[n]["coverage"] >= got[n]["overlaps"] >= got[n]["conflicts"]


def test_silent_rule_has_no_accuracy(spark):
    df = spark.createDataFrame([(-1, 1, 1), (-1, 0, 1)], "a int, b int, gold int")
    got = {r["rule"]: r for r in V.rule_summary(df, ["a", "b"], gold="gold").collect()}
    assert got["a"]["coverage"] == 0 and got["a"]["polarity"] == "" and got["a"]["emp_acc"] is None
    weighed = V.with_weights(V.rule_summary(df, ["a", "b"]), {"b": 0.75}).collect()
    assert {r["rule"]: r["learned_weight"] for r in weighed} == {"a": None, "b": 0.75}


def test_buckets_and_unlabeled(table):
    counts = {(r["a"], r["b"]): r["n_rows"] for r in V.label_buckets(table, "a", "b").collect()}
    assert counts == {k: 3 for k in itertools.product([-1, 0, 1], repeat=2)}
    assert V.bucket_rows(table, "a", "b", "id").where("vote_a = 1 AND vote_b = 0").count() == 3
    assert V.filter_unlabeled(table, NAMES).count() == 26


def test_explanations(table):
    long = V.explain_votes(table, NAMES, "id", table.where("id IN (0, 5)"))
    assert {tuple(r) for r in long.collect()} == {(5, "b", 0), (5, "c", 1)}
    assert V.explain_votes(table, NAMES, "id").count() == 27 * 2


def test_misclassified_edges(spark):
    rows = [("case", 0.5), ("case", 0.6), ("control", 0.5), ("control", 0.51), (None, 0.9)]
    df = spark.createDataFrame(rows, "label string, p double")
    assert {tuple(r) for r in V.misclassified(df, "label", "p").collect()} == {("case", 0.5), ("control", 0.51)}
    assert {tuple(r) for r in V.misclassified(df, "label", "p", strict=True).collect()} == {("control", 0.51)}


def test_tie_breaking_is_fair_and_fixed(spark):
    df = spark.range(4000).withColumn("p", F.lit(0.5))
    coin = df.select(V.prediction("p", "id", tie="random").alias("v"))
    share = coin.agg(F.avg("v")).first()[0]
    assert 0.45 < share < 0.55
    again = df.repartition(13).select(V.prediction("p", "id", tie="random").alias("v")).agg(F.avg("v")).first()[0]
    assert again == share
    assert df.select(V.prediction("p", "id").alias("v")).distinct().collect()[0]["v"] == -1
    with pytest.raises(ValueError):
        V.prediction("p", "id", tie="other")


def test_partitioning_does_not_change_the_summary(table):
    a = V.rule_summary(table.repartition(1), NAMES).toPandas()
    b = V.rule_summary(table.repartition(9), NAMES).toPandas()
    pd.testing.assert_frame_equal(a, b)
    assert np.all(a["coverage"] <= 1)
