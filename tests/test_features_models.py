import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weaklabel.operators import features as X, models as M
from weaklabel.sources.tables import ResultStore


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    y = (rng.random(300) < 0.4).astype(int)
    a, b = rng.normal(size=300) + 1.5 * y, rng.normal(size=300) * 2 - y
    df = pd.DataFrame({"id": np.arange(300), "a": a, "b": b, "y": y, "w": rng.random(300)})
    return X.assemble(spark.createDataFrame(df), ["a", "b"]).persist(), df


def test_targets_and_flags(spark):
    df = spark.createDataFrame([(1, 0.1, None), (2, 0.9, "case"), (3, 0.4, "control")], "id int, p double, label string")
    low, high = X.probability_limits(df, "p").first()
    assert (low, high) == (pytest.approx(0.095), pytest.approx(0.95 * 0.1 + 0.9))
    out = X.blended_outcome(df, "p").withColumns({"y": X.hard_target("outcome"), "w": X.confidence_weight("p")})
    assert {r["id"]: (r["y"], round(r["w"], 6)) for r in out.collect()} == {1: (0, 0.4), 2: (1, 0.4), 3: (0, 0.1)}
    drugs = spark.createDataFrame(
        [(1, "EPIC IP ADMIN"), (1, "x"), (2, "hed"), (3, "a HED b"), (4, None), (None, "HED")], "v long, t string"
    )
    assert {r["v"]: r["binary_naloxone_admin"] for r in X.treatment_flag(drugs, ["v"], "t").collect()} == {1: 1, 2: 0, 3: 1, 4: 0}


def test_feature_order_and_scaling(spark):
    df = spark.createDataFrame([(1, 2.0, 1, None, 3), (2, 4.0, 0, 5, 3)], "id int, age double, binary_x int, counts_y int, counts_z int")
    columns = X.feature_columns(df, ["age"])
    assert columns == ["age", "binary_x", "counts_y", "counts_z"]
    matrix = X.feature_matrix(df, columns, ["id"])
    assert matrix.where("id = 1").first().asDict() == {"id": 1, "age": 2.0, "binary_x": 1.0, "counts_y": 0.0, "counts_z": 3.0}
    got = X.standardize(matrix, columns, X.scaling(matrix, columns)).orderBy("id").collect()
    assert [list(r)[1:] for r in got] == [[-1.0, 1.0, -1.0, 0.0], [1.0, -1.0, 1.0, 0.0]]


def test_discriminant_matches_closed_form(points):
    df, local = points
    model = M.Discriminant.fit(df, ["a", "b"])
    x, y = local[["a", "b"]].to_numpy(), local["y"].to_numpy()
    m0, m1 = x[y == 0].mean(0), x[y == 1].mean(0)
    centred = x - np.where(y[:, None] == 1, m1, m0)
    slope = np.linalg.solve(centred.T @ centred / len(x), m1 - m0)
    np.testing.assert_allclose(model.slope, slope)
    assert model.intercept == pytest.approx(np.log(y.mean() / (1 - y.mean())) - (m0 + m1) / 2 @ slope)
    p = df.withColumn("p", model.prob_case()).agg(F.avg(((F.col("p") > 0.5) == (F.col("y") == 1)).cast("int"))).first()[0]
    assert p > 0.7


def test_gaussian_bayes_matches_closed_form(points):
    df, local = points
    got = {r["id"]: r["log_odds"] for r in M.gaussian_bayes_scores(df, df, ["a", "b"]).collect()}
    x, y = local[["a", "b"]].to_numpy(), local["y"].to_numpy()
    eps = x.var(0).max() * 1e-9
    odds = np.log(y.sum() / (1 - y).sum())
    for k, sign in ((1, 1), (0, -1)):
        m, v = x[y == k].mean(0), x[y == k].var(0) + eps
        odds = odds + sign * (-0.5 * np.log(2 * np.pi * v) - (x - m) ** 2 / (2 * v)).sum(1)
    np.testing.assert_allclose([got[i] for i in local["id"]], odds)


@pytest.mark.parametrize("block_rows", [17, 10_000])
def test_neighbours_equal_brute_force(spark, block_rows):
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=(120, 3)), 1)
    v[40:70] = v[0]
    label = rng.integers(0, 3, 120)
    df = spark.createDataFrame([(i, v[i].tolist(), int(label[i])) for i in range(120)], "id long, v array<double>, label int")
    got = M.nearest_neighbours(df, df, "id", "v", "label", k=4, block_rows=block_rows, skip_self=True).collect()
    found = {i: [r["neighbour"] for r in sorted(got, key=lambda r: r["rank"]) if r["id"] == i] for i in range(120)}
    for i in range(120):
        d = np.round(((v - v[i]) ** 2).sum(1), 6)
        assert found[i] == sorted([j for j in range(120) if j != i], key=lambda j: (d[j], j))[:4]


def test_neighbour_vote_breaks_ties_low(spark):
    df = spark.createDataFrame([(1, 3), (1, 2), (1, 3), (2, 5), (2, 4)], "id int, label int")
    assert {tuple(r) for r in M.neighbour_vote(df, "id").collect()} == {(1, 3, 2), (2, 4, 1)}


def test_class_weights(points):
    df, local = points
    n, n1 = 300, int(local["y"].sum())
    balanced = M.with_class_weight(df, "balanced", None, "cw").groupBy("y").agg(F.first("cw")).collect()
    assert dict(map(tuple, balanced)) == {1: pytest.approx(n / (2 * n1)), 0: pytest.approx(n / (2 * (n - n1)))}
    both = M.with_class_weight(df, {0: 0.99, 1: 0.01}, "w", "cw").where("y = 1").select(F.max(F.abs(F.col("cw") - 0.01 * F.col("w"))))
    assert both.first()[0] == 0
    plain = M.with_class_weight(df, None, None, "cw").agg(F.min("cw"), F.max("cw")).first()
    assert tuple(plain) == (1.0, 1.0)


def test_depth_limit():
    assert [M.tree_depth(d) for d in (None, 5, 30, 50)] == [30, 5, 30, 30]
    assert [M.forest_features(f) for f in (None, "sqrt", "log2")] == ["all", "sqrt", "log2"]


def test_screening_and_importance(points):
    df, _ = points
    chosen = M.classifiers(2, trees=5)
    out = M.screen(df, {"CART": chosen["CART"], "NB": chosen["NB"]}, "id", k=3).collect()
    assert len(out) == 2 * 3 * 3
    assert all(0.5 < r["value"] <= 1 for r in out if r["metric"] == "roc_auc")
    model = M.forest_classifier(trees=5, depth=4).fit(df)
    top = M.feature_importance(model, ["a", "b"]).collect()
    assert [r["rank"] for r in top] == [1, 2] and sum(r["importance"] for r in top) == pytest.approx(1)


def test_nested_cv_resumes(points, spark, tmp_path):
    df, _ = points
    store = ResultStore(spark, str(tmp_path / "cv"))
    tree = M.classifiers(2)["CART"]
    args = dict(key="id", name="CART", weight="w", k_outer=2, k_inner=2, store=store)
    first = M.nested_cv(df, tree, {"maxDepth": [2, 4]}, **args)
    assert first.count() == 8
    again = M.nested_cv(df, tree, {"maxDepth": [2, 4]}, **args)
    assert again.count() == 8, "finished folds are not run twice"
    wanted = spark.createDataFrame([("CART", first.first()["params"]), ("RF", "x")], "model string, params string")
    assert [r["model"] for r in store.pending(wanted).collect()] == ["RF"]
    other = M.nested_cv(df, tree, {"maxDepth": [1, 3]}, **args)
    assert other.count() == 8 and {json.loads(r["params"])["maxDepth"] for r in other.collect()} <= {1, 3}


def test_a_weight_that_the_learner_cannot_use_is_refused(points):
    df, _ = points
    with pytest.raises(ValueError, match="weights"):
        M.nested_cv(df, M.perceptron([2, 3, 2]), {}, key="id", name="NN", weight="w", k_outer=2, k_inner=2)


def test_a_regressor_scores_its_own_scale(spark):
    df = spark.createDataFrame([(float(x), 2.0 * x) for x in range(1, 20)], "x double, y double")
    ready = X.assemble(df, ["x"])
    model = M.regressors()["LR"].fit(ready)
    three = ready.where("x = 3")
    assert M.score(model, three).first()["prob"] == pytest.approx(6)
    assert M.score(model, three, log_scale=True).first()["prob"] == pytest.approx(np.exp(6))


def test_screening_takes_every_learner(points):
    df, _ = points
    chosen = M.classifiers(2, trees=5, depth=5, key="id")
    out = M.screen(df, {n: chosen[n] for n in ("LDA", "KNN", "LR")}, "id", k=2).collect()
    assert {r["model"] for r in out} == {"LDA", "KNN", "LR"}
    assert all(0.5 < r["value"] <= 1 for r in out if r["metric"] == "roc_auc")


def test_exactly_half_is_class_zero(points):
    df, _ = points

    class Half:
        def transform(self, d):
            from pyspark.ml.functions import array_to_vector

            return d.withColumn("probability", array_to_vector(F.array(F.lit(0.5), F.lit(0.5))))

    assert M.score(Half(), df).agg(F.max("predicted")).first()[0] == 0


def test_newton_steps_equal_a_plain_solve(points):
    df, local = points
    x = np.c_[np.ones(300), local[["a", "b"]].to_numpy()]
    y, held = local["y"].to_numpy(), np.array([0, 1, 1]) / 0.5
    beta = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        beta -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(held), x.T @ (p - y) + held * beta)
    got = M.NewtonLogistic(["a", "b"], c=0.5)
    np.testing.assert_allclose(got.coefficients(df), beta, atol=1e-8)
    again = M.score(M.VectorLogistic(2, c=0.5).fit(df), df).agg(F.sum("prob")).first()[0]
    assert again == pytest.approx((1 / (1 + np.exp(-x @ beta))).sum())


def test_newton_steps_of_classes_far_apart_end(spark):
    df = spark.createDataFrame([(float(x), int(x > 0)) for x in range(-50, 51) if x], "a double, y int")
    beta = M.NewtonLogistic(["a"], c=1e6).coefficients(df)
    assert np.isfinite(beta).all() and beta[1] > 0.5


def test_inner_folds_of_one_table_are_even(points):
    df, _ = points
    folds = M.nested_folds(df, "id", 5, 3).persist()
    assert folds.count() == 300
    for f in range(1, 6):
        sizes = [r["count"] for r in folds.where(F.col("outer") != f).groupBy("inner").count().collect()]
        assert len(sizes) == 3 and max(sizes) - min(sizes) <= 4


def test_nested_cv_of_own_learners(points, spark, tmp_path):
    from weaklabel.operators.forest import ForestLearner

    df, _ = points
    store = ResultStore(spark, str(tmp_path / "cv"))
    args = dict(key="id", name="RF", weight="w", k_outer=2, k_inner=2, store=store)
    grid = {"depth": [0, 3], "class_weight": ["balanced_subsample"]}
    out = M.nested_cv(df, ForestLearner(trees=5, key="id"), grid, **args).collect()
    assert len(out) == 8 and {json.loads(r["params"])["depth"] for r in out} == {3}
    inner = store.load().where("run LIKE '%|inner'")
    assert inner.count() == 2 * 2 * 2, "two folds, settings and inner folds"


def test_a_restart_takes_inner_scores_from_the_store(points, spark, tmp_path):
    from weaklabel.operators.network import NetworkLearner

    df, _ = points
    calls = []

    class Counted(NetworkLearner):
        def fit(self, rows):
            calls.append(self.hidden)
            return super().fit(rows)

    learner = Counted(hidden=(2,), max_iter=3)
    store = ResultStore(spark, str(tmp_path / "cv"))
    args = dict(key="id", name="NN", k_outer=2, k_inner=2, store=store)
    M.nested_cv(df, learner, {"hidden": [(2,), (3,)]}, **args)
    assert len(calls) == 2 * (2 * 2 + 1)
    # the outer scores are lost, the inner ones are not: only the refits run again
    kept = store.load().where("run LIKE '%|inner'")
    other = ResultStore(spark, str(tmp_path / "other"))
    other.append(kept)
    calls.clear()
    again = M.nested_cv(df, learner, {"hidden": [(2,), (3,)]}, **args | {"store": other})
    assert again.count() == 8 and len(calls) == 2


def test_far_blocks_never_meet(spark):
    rng = np.random.default_rng(3)
    centres = 100 * rng.normal(size=(8, 4))
    v = centres[np.arange(800) % 8] + rng.normal(size=(800, 4))
    df = spark.createDataFrame([(i, v[i].tolist(), int(i % 3)) for i in range(800)], "id long, v array<double>, label int")
    report = {}
    got = M.nearest_neighbours(df, df.where("id < 200"), "id", "v", "label", k=4, block_rows=25, skip_self=True, report=report).collect()
    assert report["compared"] < 0.5 * report["all"], report
    found = {i: [r["neighbour"] for r in sorted(got, key=lambda r: r["rank"]) if r["id"] == i] for i in range(200)}
    for i in range(200):
        d = np.round(((v - v[i]) ** 2).sum(1), 6)
        assert found[i] == sorted([j for j in range(800) if j != i], key=lambda j: (d[j], j))[:4]


def test_neighbours_of_few_or_equal_rows(spark):
    kind = "id long, v array<double>, label int"
    same = spark.createDataFrame([(i, [1.0, 1.0], i) for i in range(30)], kind)
    got = M.nearest_neighbours(same, same, "id", "v", "label", k=3, block_rows=4, skip_self=True).collect()
    assert {i: sorted(r["neighbour"] for r in got if r["id"] == i) for i in (0, 7)} == {0: [1, 2, 3], 7: [0, 1, 2]}
    two = same.where("id < 2")
    assert M.nearest_neighbours(two, same, "id", "v", "label", k=3).count() == 60
    assert M.nearest_neighbours(two.where("id < 0"), same, "id", "v", "label").count() == 0
    assert M.nearest_neighbours(two, same.where("id < 0"), "id", "v", "label").count() == 0
