"""What a larger or odder table must not do to the learners: one task a row, a model on the driver, an unlearnable row."""

import math
import random
import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weaklabel.catalog import CATALOG, model_queries
from weaklabel.catalog.views import PATTERNS
from weaklabel.operators import features as X, forest as T, models as M, neighbours as N, network as NW


def frame(spark, x, y):
    data = pd.DataFrame(x, columns=[f"x{i}" for i in range(x.shape[1])]).assign(id=np.arange(len(x)), y=y)
    return X.assemble(spark.createDataFrame(data), [f"x{i}" for i in range(x.shape[1])])


def test_values_without_logarithm_are_scored_and_not_learned(spark, tmp_path):
    rows = [(1, 100.0), (2, 200.0), (3, 400.0), (4, 0.0), (5, -100.0), (6, None)]
    spark.createDataFrame(rows, "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: r["prob"] for r in CATALOG["linear_regressor"].run(spark, str(tmp_path)).collect()}
    slope, start = np.polyfit([1, 2, 4], np.log([100, 200, 400]), 1)
    want = {i: None if v is None else math.exp(start + slope * v / 100) for i, v in rows}
    assert got.pop(6) is None and want.pop(6) is None
    assert got == pytest.approx(want, abs=1e-3)


def test_groups_are_few_however_few_rows_a_node_may_have(spark):
    n, asked = 3000, []
    df = frame(spark, np.arange(n, dtype=float)[:, None], (np.arange(n) % 2).astype(float))
    plain = type(df).repartition

    def counted(self, *by):
        asked.append(by[0])
        return plain(self, *by)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(df), "repartition", counted)
        model = T.ForestLearner(trees=1, depth=1, bootstrap=False, key="id", local_cells=2).fit(df)
    assert model.trees[0].nodes == 3 and max(asked) <= 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("kind", ["classes", "regression", "large nodes"])
def test_a_forest_left_in_its_table_scores_as_one_on_the_driver(spark, monkeypatch, kind):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(500, 3)), 1)
    x[100:200] = x[:100]
    y = x[:, 0] + rng.normal(size=500) if kind == "regression" else (x[:, 0] + rng.normal(size=500) > 0).astype(float)
    df = frame(spark, x, y)
    learner = T.ForestLearner(trees=4, depth=4, features="sqrt" if kind == "classes" else None, regression=kind == "regression", key="id", local_cells=600 if kind == "large nodes" else 10**6)
    kept = learner.fit(df)
    monkeypatch.setattr(T, "KEPT_NODES", 10)
    monkeypatch.setattr(T, "CELL_ROWS", 100)
    monkeypatch.setattr(T, "_fetched", lambda table: pytest.fail("no nodes on the driver"))
    left = learner.fit(df)
    assert isinstance(kept, T.ForestModel) and isinstance(left, T.WrittenForest)
    said = [[r["prob"] for r in M.score(m, df).orderBy("id").collect()] for m in (kept, left)]
    np.testing.assert_allclose(said[0], said[1], rtol=1e-12)
    for a, b in zip(kept.trees, left.trees, strict=True):
        assert (a.nodes, a.depth, a.threshold) == (b.nodes, b.depth, b.threshold)
        np.testing.assert_allclose(a.gains, b.gains)
    np.testing.assert_allclose(kept.featureImportances.toArray(), left.featureImportances.toArray())


def test_features_that_differ_each_time_they_are_worked_out_are_scored(spark, monkeypatch):
    rng = np.random.default_rng(15)
    df = frame(spark, rng.normal(size=(200, 2)), rng.integers(0, 2, 200).astype(float))
    monkeypatch.setattr(T, "KEPT_NODES", 10)
    model = T.ForestLearner(trees=3, key="id").fit(df)
    # as sums of doubles are, whose last places go by the order of tasks
    shaken = F.udf(lambda v: v + random.random() * 1e-9, "double").asNondeterministic()
    rows = X.assemble(df.drop("features").withColumn("x0", shaken("x0")), ["x0", "x1"])
    scored = M.score(model, rows).select("id", "prob", "predicted").collect()
    assert len(scored) == 200 and all(r["prob"] is not None and r["predicted"] is not None for r in scored)


def test_blocks_move_by_tiles_and_find_the_same_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(400, 3)), 2)
    df = spark.createDataFrame([(i, v.tolist(), i % 5) for i, v in enumerate(x)], "id long, v array<double>, label int")
    moved = []
    plain = N._compare

    def counted(width, k, skip_self, digits):
        work, cells = plain(width, k, skip_self, digits), spark.sparkContext.accumulator(0)
        moved.append(cells)

        def counting(asked, held):
            cells.add(asked.num_rows + held.num_rows)
            return work(asked, held)

        return counting

    monkeypatch.setattr(N, "_compare", counted)
    report = {}
    got = M.nearest_neighbours(df, df, "id", "v", "label", k=4, block_rows=8, skip_self=True, pivots=2, report=report)
    got = {(r["id"], r["rank"]): r["neighbour"] for r in got.collect()}
    d = np.round(((x[:, None] - x[None]) ** 2).sum(axis=2), 6) + np.where(np.eye(400) > 0, np.inf, 0)
    order = np.lexsort((np.broadcast_to(np.arange(400), d.shape), d), axis=1)[:, :4]
    assert got == {(i, r + 1): int(order[i, r]) for i in range(400) for r in range(4)}
    assert sum(c.value for c in moved) < report["compared"], "fewer blocks move than are compared"


def test_neighbours_of_equal_vectors_are_looked_for_once(spark):
    rng = np.random.default_rng(18)
    x = rng.integers(0, 3, (400, 2)).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), i % 5) for i, v in enumerate(x)], "id long, v array<double>, label int")
    report = {}
    train, asked = df.where("id % 3 > 0"), df.where("id % 3 = 0")
    got = M.nearest_neighbours(train, asked, "id", "v", "label", k=4, block_rows=8, pivots=2, report=report).collect()
    ids, want = np.flatnonzero(np.arange(400) % 3), set()
    for i in range(0, 400, 3):
        d = ((x[ids] - x[i]) ** 2).sum(axis=1)
        want |= {(i, r + 1, int(ids[j]), float(d[j]), int(ids[j]) % 5) for r, j in enumerate(np.lexsort((ids, d))[:4])}
    assert {(r["id"], r["rank"], r["neighbour"], r["distance2"], r["label"]) for r in got} == want
    # nine vectors, of each of which four train rows count: 134 rows asked of 266 would be 17 blocks and 34 at least
    assert report["all"] < 17 * 34 / 4


def test_small_nodes_of_all_levels_are_grown_by_one_job(spark, monkeypatch):
    # stripes of falling weight are cut off one by one, each level leaves a small node behind
    x = np.repeat(np.arange(20.0), 40)[:, None]
    data = frame(spark, x, x[:, 0] % 2).withColumn("w", F.pow(F.lit(0.5), "x0"))
    made, plain = [], T.written
    monkeypatch.setattr(T, "written", lambda df, name: made.append(name) or plain(df, name))
    large, small = (T.ForestLearner(trees=1, bootstrap=False, weight="w", key="id", local_cells=c).fit(data) for c in (300, 10**6))
    assert made.count("moved-rows") > 5 and made.count("forest-parts") == 2, "one for each fit"
    assert (large.trees[0].nodes, large.trees[0].depth) == (small.trees[0].nodes, small.trees[0].depth)
    assert M.score(large, data).where("predicted <> y").isEmpty()


@pytest.mark.parametrize("weights", [None, "balanced", "balanced_subsample", {0: 0.2, 1: 0.8}])
def test_trees_of_a_run_draw_the_rows_that_spark_would_draw(spark, monkeypatch, weights):
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(300, 3)), 1)
    df = frame(spark, x, (x[:, 0] + rng.normal(size=300) > 0).astype(float))
    learner = T.ForestLearner(trees=5, depth=4, features="sqrt" if weights is None else None, class_weight=weights, key="id")
    one_by_one = learner.with_settings(local_cells=897, features=None).fit(df)
    monkeypatch.setattr(T.ForestLearner, "draw", lambda *_: pytest.fail("rows are not written out for each tree"))
    by_runs = learner.with_settings(features=None).fit(df)
    said = [[r["prob"] for r in M.score(m, df).orderBy("id").collect()] for m in (one_by_one, by_runs)]
    np.testing.assert_allclose(said[0], said[1], rtol=1e-9)
    assert [t.nodes for t in one_by_one.trees] == [t.nodes for t in by_runs.trees]


@pytest.mark.parametrize("regression", [False, True])
def test_rows_of_the_same_features_are_one_row_of_a_tree(spark, monkeypatch, regression):
    rng = np.random.default_rng(16)
    x = rng.integers(0, 3, (600, 2)).astype(float)
    y = np.round(rng.normal(size=600), 1) if regression else rng.integers(0, 2, 600).astype(float)
    odd = F.when(F.col("id") % 7 == 0, F.lit(None)).when(F.col("id") % 5 == 0, -1.0).otherwise(F.col("id") % 3)
    df = frame(spark, x, y).withColumn("w", odd)
    learner = T.ForestLearner(trees=6, depth=3, weight="w", regression=regression, key="id", local_cells=1100)
    one_by_one = learner.fit(df)
    grown, plain = spark.sparkContext.accumulator(0), T.grow_coded

    def counted(codes, *rest):
        grown.add(codes.shape[1])
        return plain(codes, *rest)

    monkeypatch.setattr(T, "grow_coded", counted)
    by_runs = learner.with_settings(local_cells=T.LOCAL_CELLS).fit(df)
    assert grown.value <= 6 * 9, "six trees over nine rows of features, however many rows have them"
    said = [[r["prob"] for r in M.score(m, df).orderBy("id").collect()] for m in (one_by_one, by_runs)]
    np.testing.assert_allclose(said[0], said[1], rtol=1e-9)


def test_a_forest_of_many_rows_scores_distinct_features(spark, monkeypatch):
    rng = np.random.default_rng(17)
    x = rng.integers(0, 3, (400, 2)).astype(float)
    df = frame(spark, x, rng.integers(0, 2, 400).astype(float))
    scored, plain = spark.sparkContext.accumulator(0), T.predicted_sum

    def counted(rows, *rest):
        scored.add(len(rows))
        return plain(rows, *rest)

    monkeypatch.setattr(T, "predicted_sum", counted)
    monkeypatch.setattr(T, "KEPT_VISITS", 1000, raising=False)
    model = T.ForestLearner(trees=3, key="id").fit(df)
    assert M.score(model, df).where("prob is not null").count() == 400
    assert scored.value <= 9 * 3, "each row of features once for each run of trees"


def test_draws_in_a_task_are_those_of_spark(spark):
    rows = spark.range(2000).select(F.xxhash64("id").alias("key"), F.lit(3).alias("tree"))
    found = rows.select("key", T.drawn_times(F.col("key"), F.col("tree"), 987).alias("times")).toPandas()
    assert T._times_of(found["key"].to_numpy(), 3, 987).tolist() == found["times"].tolist()
    assert found["times"].nunique() > 3


def test_a_network_steps_over_even_parts_however_rows_come(spark, monkeypatch):
    rng = np.random.default_rng(12)
    df = frame(spark, rng.normal(size=(1000, 2)), rng.normal(size=1000)).coalesce(1)
    monkeypatch.setattr(NW, "BLOCK_ROWS", 20)
    parts, plain = [], NW.NetworkLearner._fit
    monkeypatch.setattr(NW.NetworkLearner, "_fit", lambda self, blocks, *a: parts.append(sorted(r["count"] for r in blocks.groupBy(F.spark_partition_id()).count().collect())) or plain(self, blocks, *a))
    learner = NW.NetworkLearner(hidden=(3,), max_iter=3, regression=True)
    even = learner.fit(df)
    cores = spark.sparkContext.defaultParallelism
    assert sum(parts[0]) == 50 and len(parts[0]) == 2 * cores and parts[0][-1] <= parts[0][0] + 1
    monkeypatch.undo()
    whole = learner.fit(df)
    np.testing.assert_allclose(even.losses, whole.losses)


def test_equal_rows_are_one_row_of_a_network(spark):
    rng = np.random.default_rng(19)
    x = rng.integers(0, 2, (300, 2)).astype(float)
    df = frame(spark, x, rng.integers(0, 2, 300).astype(float)).withColumn("w", F.col("id") % 3 + 1)
    blocks = NW.pack(df, "w").agg(F.sum("n"), F.sum("weight"), F.sum(F.length("y") / 8)).first()
    assert blocks[0] == 300 and blocks[1] == 600 and blocks[2] <= 8
    learner = NW.NetworkLearner(hidden=(3,), activation="tanh", max_iter=3, weight="w")
    found = df.toPandas()
    layers = NW.start_weights([2, 3, 1], "tanh", learner.seed)
    loss = NW.loss_gradient(x, found["y"].to_numpy(), found["w"].to_numpy().astype(float), layers, "tanh", False)[0]
    held = sum((w**2).sum() for w, _ in layers)
    assert learner.fit(df).losses[0] == pytest.approx(loss / 600 + 0.5 * learner.alpha * held / 300)


@pytest.mark.parametrize("way", ["screen", "nested"])
def test_rows_to_fold_are_worked_out_once(spark, way):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(200, 2))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        seen.add(1)
        return v

    df = frame(spark, x, (x[:, 0] > 0).astype(float)).withColumn("y", counted.asNondeterministic()("y"))
    tree = M.classifiers(2, depth=2)["CART"]
    if way == "screen":
        found = M.screen(df, {"CART": tree}, "id", k=2).count()
    else:
        found = M.nested_cv(df, tree, {"maxDepth": [1, 2]}, "id", "CART", k_outer=2, k_inner=2).count()
    assert found > 0 and seen.value == 200


def test_what_a_model_does_before_it_predicts_runs_beside_the_fits(spark):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(100, 2))
    df = frame(spark, x, (x[:, 0] > 0).astype(float))
    where, tree = [], M.classifiers(2, depth=2)["CART"]

    class Slow:
        def fit(self, rows):
            model = tree.fit(rows)
            return M.Fitted(lambda part: where.append(threading.current_thread()) or model.transform(part))

    assert M.screen(df, {"slow": Slow()}, "id", k=2).count() == 6
    assert len(where) == 2 and threading.main_thread() not in where


def test_deep_forests_keep_the_nodes_of_rows():
    for forest in (M.classifiers(2)["RF"], M.regressors()["RF"]):
        assert forest.getCacheNodeIds() and forest.getMaxMemoryInMB() == 1024


def test_nested_forests_are_those_of_the_whole_grid(spark, tiny, monkeypatch):
    asked = {}

    def seen(df, estimator, grid, key, name, **settings):
        asked.update(estimator=estimator, grid=grid, **settings)
        return df

    monkeypatch.setattr(model_queries, "nested_cv", seen)
    CATALOG["nested_forest"].run(spark, tiny)
    assert asked["estimator"].trees == 250 and not {"k_outer", "k_inner"} & set(asked)
    weights = [None, "balanced", "balanced_subsample", {0: 0.99, 1: 0.01}, {0: 0.01, 1: 0.99}]
    assert asked["grid"] == {"class_weight": weights, "depth": [None, 5, 10, 50], "features": [None, "sqrt", "log2"]}


def test_patterns_are_counted_as_regular_expressions_of_spark_are(spark):
    texts = ["", None, "License COPYRIGHT licenseLICENSE", "licen\u017fe to\u212aen toKEN", "secretoken secret token Password", "!!?? ! a?!\n\n\r\n", "555 1234 555-12345551234 5555.55555", "\u00e9\u4e2d!!\n\U0001f600??", "x" * 1000 + "!?" * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = df.select("id", *[F.regexp_count("text", F.lit(p)).cast("long").alias(n) for n, p in PATTERNS.items()])
    got = X.count_patterns(df, "text", PATTERNS)
    assert got.schema == want.schema and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
