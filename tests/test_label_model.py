import numpy as np
import pytest
from pyspark.sql import functions as F

from weaklabel.operators.evaluate import auc_of_scores
from weaklabel.operators.label_model import LabelModel, accuracy, class_balance_of, overlap_matrix, solve, tune, vote_pairs, vote_patterns, weights_of
from weaklabel.operators.votes import with_majority


def planted(spark, n, prior, accuracies, coverages, seed=0):
    """Independent rules with known accuracy and coverage."""
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < prior).astype(int)
    columns = {"id": np.arange(n), "y": y}
    for j, (a, c) in enumerate(zip(accuracies, coverages, strict=True)):
        vote = np.where(rng.random(n) < a, y, 1 - y)
        columns[f"r{j}"] = np.where(rng.random(n) < c, vote, -1)
    import pandas as pd

    names = [f"r{j}" for j in range(len(accuracies))]
    return spark.createDataFrame(pd.DataFrame(columns)).repartition(4), names


ACC = [0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 0.65]
COV = [0.9, 0.3, 0.5, 0.7, 0.4, 0.6, 0.35, 0.8]


@pytest.mark.parametrize("prior", [0.5, 0.2])
def test_planted_accuracies_are_recovered(spark, prior):
    votes, names = planted(spark, 50_000, prior, ACC, COV)
    model = LabelModel.fit(votes, names, class_balance=(1 - prior, prior))
    for got, want in zip(model.weights().values(), ACC, strict=True):
        assert got == pytest.approx(want, abs=0.03)


def test_rare_class_beats_majority_vote(spark):
    votes, names = planted(spark, 50_000, 0.015, ACC, COV, seed=2)
    model = LabelModel.fit(votes, names, class_balance=(0.985, 0.015), starts=(None, 123, 987))
    scored = with_majority(votes, names).withColumnRenamed("prob_case", "majority").withColumn("model", model.prob_case())
    auc = {r["model"]: r["auc"] for r in auc_of_scores(scored, "y", ["majority", "model"]).collect()}
    assert auc["model"] > auc["majority"]
    assert 0 <= model.spread < 0.5


def test_overlaps_equal_brute_force(spark):
    votes, names = planted(spark, 700, 0.4, [0.8, 0.7, 0.9], [0.5, 0.9, 0.4])
    local = votes.toPandas()[names].to_numpy()
    held = np.concatenate([[(local[:, r] == y) for y in (0, 1)] for r in range(3)]).astype(float)
    got, rows = overlap_matrix(votes, names)
    assert rows == 700
    np.testing.assert_allclose(got, held @ held.T / 700)
    np.testing.assert_allclose(overlap_matrix(votes, names, compress=False)[0], got)
    assert vote_patterns(votes, names).agg(F.sum("n_rows")).first()[0] == 700
    assert vote_pairs(vote_patterns(votes, names), names).where("i > j").count() == 0


def test_scores_follow_bayes_rule(spark):
    mu = np.array([[0.5, 0.1], [0.1, 0.6], [0.3, 0.2], [0.2, 0.4]])
    model = LabelModel(["a", "b"], (0.8, 0.2), mu)
    rows = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    df = spark.createDataFrame(rows, "a int, b int")
    for r in model.score(df).collect():
        p = np.array([0.8, 0.2])
        for j, v in enumerate((r["a"], r["b"])):
            if v >= 0:
                p = p * mu[2 * j + v]
        assert r["prob_case"] == pytest.approx(p[1] / p.sum())


def test_equal_rules_agree_with_majority(spark):
    mu = np.array([[0.6, 0.2], [0.2, 0.6]] * 3)
    model = LabelModel(["a", "b", "c"], (0.5, 0.5), mu)
    rows = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    df = with_majority(spark.createDataFrame(rows, "a int, b int, c int"), ["a", "b", "c"])
    for r in df.withColumn("p", F.round(model.prob_case(), 9)).collect():
        if r["prob_case"] != 0.5:
            assert (r["p"] > 0.5) == (r["prob_case"] > 0.5)
        else:
            assert r["p"] == 0.5


def test_class_balance_wins_over_gold(spark):
    votes, names = planted(spark, 500, 0.5, [0.8, 0.8, 0.8], [1.0, 1.0, 1.0])
    both = LabelModel.fit(votes, names, class_balance=(0.9, 0.1), gold=(votes, "y"), n_epochs=5)
    assert both.prior == (0.9, 0.1)
    from_gold = LabelModel.fit(votes, names, gold=(votes, "y"), n_epochs=5)
    assert from_gold.prior[1] == pytest.approx(votes.agg(F.avg("y")).first()[0])
    assert LabelModel.fit(votes, names, n_epochs=5).prior == (0.5, 0.5)


def test_start_is_fixed_and_schedules_work(spark):
    votes, names = planted(spark, 2000, 0.3, [0.8, 0.7, 0.9], [0.6, 0.7, 0.8])
    o, _ = overlap_matrix(votes, names)
    a, b = solve(o, (0.7, 0.3), 300), solve(o, (0.7, 0.3), 300)
    np.testing.assert_array_equal(a[0], b[0])
    for schedule in ("constant", "linear", "exponential", "step"):
        mu, loss = solve(o, (0.7, 0.3), 300, lr_scheduler=schedule, seed=123)
        assert np.all((mu > 0) & (mu < 1)) and loss < 0.1
        assert all(0 < w <= 1 for w in weights_of(mu, (0.7, 0.3), o))
    with pytest.raises(ValueError):
        solve(o, (0.7, 0.3), 5, lr_scheduler="cosine")


def test_parameters_survive_a_table(spark):
    mu = np.array([[0.5, 0.1], [0.1, 0.6]])
    model = LabelModel(["a"], (0.8, 0.2), mu)
    back = LabelModel.from_parameters(model.parameters(spark), (0.8, 0.2), ["a"])
    np.testing.assert_array_equal(back.mu, mu)


def test_accuracy_leaves_ties_out(spark):
    df = spark.createDataFrame([(1, 0.9, 1), (2, 0.1, 1), (3, 0.5, 1)], "id int, p double, y int")
    got = accuracy(df, "p", "y", "id").first()
    assert (got["n_rows"], got["accuracy"]) == (2, 0.5)
    assert accuracy(df, "p", "y", "id", tie="random").first()["n_rows"] == 3


def test_tuning_grid_shape(spark):
    votes, names = planted(spark, 1500, 0.3, [0.8, 0.7, 0.9], [0.6, 0.7, 0.8])
    grid = tune(votes, votes, names, "y", (0.7, 0.3), n_epochs=[50, 100], lr=[0.01], lr_scheduler=["step", "linear"], seed=[1, 2])
    assert grid.columns == ["n_epochs", "lr", "lr_scheduler", "seed", *names, "accuracy"]
    rows = grid.collect()
    assert len(rows) == 8 and all(0.5 < r["accuracy"] <= 1 for r in rows)


def test_class_balance_of_rows_without_a_case(spark):
    none = spark.createDataFrame([(0,)] * 9 + [(None,)], "y int")
    assert class_balance_of(none, "y") == pytest.approx((0.95, 0.05))
    with pytest.raises(ValueError, match="class balance"):
        class_balance_of(none.where("y IS NULL"), "y")


def test_triples_give_planted_accuracies(spark):
    import numpy as np

    from weaklabel.operators.label_model import LabelModel, accuracies_by_triples, vote_pairs, vote_patterns

    rng = np.random.default_rng(8)
    names, planted = ["r1", "r2", "r3", "r4"], [0.9, 0.8, 0.7, 0.85]
    y = rng.integers(0, 2, 20_000)
    votes = {n: np.where(rng.random(20_000) < 0.7, np.where(rng.random(20_000) < a, y, 1 - y), -1) for n, a in zip(names, planted)}
    df = spark.createDataFrame([tuple(int(votes[n][i]) for n in names) for i in range(20_000)], ", ".join(f"{n} int" for n in names))
    found = {r["rule"]: (r["n_triples"], r["learned_weight"]) for r in accuracies_by_triples(vote_pairs(vote_patterns(df, names), names), names).collect()}
    fitted = LabelModel.fit(df, names).weights()
    for n, a in zip(names, planted):
        assert found[n][0] == 3 and found[n][1] == pytest.approx(a, abs=0.03) and found[n][1] == pytest.approx(fitted[n], abs=0.05)


def test_a_rule_without_triples_has_no_weight(spark):
    from weaklabel.operators.label_model import accuracies_by_triples, vote_pairs, vote_patterns

    names = ["a", "b", "c"]
    df = spark.createDataFrame([(1, 1, -1), (0, 1, -1), (-1, -1, 1)], "a int, b int, c int")
    found = {r["rule"]: r["learned_weight"] for r in accuracies_by_triples(vote_pairs(vote_patterns(df, names), names), names).collect()}
    assert found == {"a": None, "b": None, "c": None}
