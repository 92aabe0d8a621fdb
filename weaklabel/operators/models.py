"""Discriminative models on soft labels: screening, nested cross-validation, refit, scoring.

Feature frames have a key, a ``features`` vector, a 0/1 ``y`` (or a real target) and, when
used, a weight column. Folds are a column, so they are the same for every model.
"""

from __future__ import annotations

import itertools
import json
import logging
import sys
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark import cloudpickle, inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weaklabel.functions.ranking import hash_rank
from weaklabel.operators.evaluate import auc_of_scores, class_of_regression, fold_metrics
from weaklabel.operators.neighbours import nearest
from weaklabel.operators.network import NetworkLearner
from weaklabel.operators.split import kfold
from weaklabel.session import cut_lineage, written

log = logging.getLogger(__name__)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_DEPTH = 30
SEED = 987
#: A level of deep trees is one pass, in which no row goes down from the root of each tree again.
DEEP_FOREST = {"cacheNodeIds": True, "maxMemoryInMB": 1024}


def tree_depth(wanted: int | None) -> int:
    """Spark trees stop at depth 30; None and deeper settings become 30, with a note."""
    if wanted is None or wanted > MAX_DEPTH:
        log.info("tree depth %s becomes %s", wanted, MAX_DEPTH)
        return MAX_DEPTH
    return wanted


def forest_features(wanted: str | None) -> str:
    return {None: "all", "sqrt": "sqrt", "log2": "log2"}[wanted]


def with_class_weight(df: DataFrame, class_weight: str | Mapping[int, float] | None, weight: str | None, out: str) -> DataFrame:
    """Row weight = sample weight x class weight. ``balanced`` weighs a class by n / (2 n_class)."""
    base = F.col(weight).cast("double") if weight else F.lit(1.0)
    if class_weight is None:
        return df.withColumn(out, base)
    if class_weight in ("balanced", "balanced_subsample"):
        sizes = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 1).alias("n1"))
        both = sizes.select(F.struct("n", "n1")).scalar()
        rows = df.withColumn("__n", both)
        case = F.col("__n.n") / (2.0 * F.greatest(F.col("__n.n1"), F.lit(1)))
        control = F.col("__n.n") / (2.0 * F.greatest(F.col("__n.n") - F.col("__n.n1"), F.lit(1)))
        return rows.withColumn(out, base * F.when(F.col("y") == 1, case).otherwise(control)).drop("__n")
    return df.withColumn(out, base * F.when(F.col("y") == 1, float(class_weight[1])).otherwise(float(class_weight[0])))


@dataclass
class Fitted:
    """A fitted learner of this package: ``transform`` adds prediction and probability columns as Spark models do."""

    add: Callable[[DataFrame], DataFrame]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.add(df)


def _with_probability(df: DataFrame, p: Column) -> DataFrame:
    both = array_to_vector(F.array(1 - p, p))
    return df.withColumn("probability", both).withColumn("prediction", (p > 0.5).cast("double"))


@dataclass
class DiscriminantLearner:
    """Linear discriminant over a feature vector, with the fit and transform of Spark estimators."""

    n_features: int

    def fit(self, df: DataFrame) -> Fitted:
        names = [f"__f{i}" for i in range(self.n_features)]

        def wide(frame: DataFrame) -> DataFrame:
            return frame.withColumn("__x", vector_to_array("features")).withColumns({n: F.col("__x")[i] for i, n in enumerate(names)})

        fitted = Discriminant.fit(wide(df), names)
        return Fitted(lambda frame: _with_probability(wide(frame), fitted.prob_case()).drop("__x", *names))


@dataclass
class NeighbourLearner:
    """The share of cases among the k nearest training rows, with the fit and transform of Spark estimators."""

    key: str
    k: int = 5

    def fit(self, df: DataFrame) -> Fitted:
        as_array = vector_to_array("features").alias("v")
        train = df.select(self.key, as_array, F.col("y").cast("int").alias("label"))

        def add(frame: DataFrame) -> DataFrame:
            # vectors of few components are cheap to compare: small blocks meet few others
            found = nearest_neighbours(train, frame.select(self.key, as_array), self.key, "v", "label", self.k, block_rows=512)
            shares = found.groupBy(self.key).agg(F.avg("label").alias("__p"))
            return _with_probability(frame.join(shares, self.key, "left"), F.col("__p")).drop("__p")

        return Fitted(add)


def classifiers(
    n_features: int, seed: int = SEED, trees: int = 100, depth: int | None = None, hidden: Sequence[int] = (100,), key: str | None = None
) -> dict:
    """Off-the-shelf classifiers of the screening step. ``depth=None`` lets trees grow as deep as Spark can.

    With ``key`` the two learners that Spark ML lacks, discriminant and neighbours, come along.
    """
    columns = {"featuresCol": "features", "labelCol": "y"}
    found = {
        "LR": VectorLogistic(n_features),
        "CART": DecisionTreeClassifier(maxDepth=tree_depth(depth), seed=seed, **columns),
        "RF": RandomForestClassifier(numTrees=trees, maxDepth=tree_depth(depth), seed=seed, **DEEP_FOREST, **columns),
        "NB": NaiveBayes(modelType="gaussian", **columns),
        "NN": NetworkLearner(hidden=tuple(hidden), activation="relu", max_iter=200, seed=seed),
    }
    return found | ({"LDA": DiscriminantLearner(n_features), "KNN": NeighbourLearner(key)} if key else {})


def regressors(seed: int = SEED, trees: int = 100, depth: int | None = None, hidden: Sequence[int] = (100,)) -> dict:
    columns = {"featuresCol": "features", "labelCol": "y"}
    return {
        "LR": LinearRegression(regParam=0.0, **columns),
        "RF": RandomForestRegressor(numTrees=trees, maxDepth=tree_depth(depth), seed=seed, **DEEP_FOREST, **columns),
        "NN": NetworkLearner(hidden=tuple(hidden), activation="relu", max_iter=200, seed=seed, regression=True),
    }


def forest_classifier(
    trees: int = 1000, depth: int | None = None, features: str | None = None, weight: str | None = None, seed: int = SEED
) -> RandomForestClassifier:
    model = RandomForestClassifier(
        featuresCol="features",
        labelCol="y",
        numTrees=trees,
        maxDepth=tree_depth(depth),
        featureSubsetStrategy=forest_features(features),
        maxMemoryInMB=1024,
        seed=seed,
    )
    return model.setWeightCol(weight) if weight else model


def forest_regressor(
    trees: int = 1000, depth: int | None = None, features: str | None = None, weight: str | None = None, seed: int = SEED
) -> RandomForestRegressor:
    model = RandomForestRegressor(
        featuresCol="features",
        labelCol="y",
        numTrees=trees,
        maxDepth=tree_depth(depth),
        featureSubsetStrategy=forest_features(features),
        maxMemoryInMB=1024,
        seed=seed,
    )
    return model.setWeightCol(weight) if weight else model


def perceptron(layers: Sequence[int], max_iter: int = 250, seed: int = SEED) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(
        featuresCol="features", labelCol="y", layers=list(layers), maxIter=max_iter, seed=seed
    )


def score(
    model: Model, df: DataFrame, prob: str = "prob", predicted: str = "predicted", log_scale: bool = False
) -> DataFrame:
    """Add the probability of case and the argmax class (exactly 0.5 is class 0).

    A regressor gives its prediction, or with ``log_scale`` its exponential, for a target that was
    a logarithm.
    """
    out = model.transform(df)
    drop = [c for c in ("rawPrediction", "probability", "prediction") if c in out.columns]
    if "probability" in out.columns:
        p = vector_to_array("probability")[1]
        return out.withColumns({prob: p, predicted: (p > 0.5).cast("int")}).drop(*drop)
    return out.withColumn(prob, F.exp("prediction") if log_scale else F.col("prediction")).drop(*drop)


def feature_importance(model, names: Sequence[str], top: int = 10) -> DataFrame:
    """Top features of a fitted forest with the population deviation over its trees."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    whole = model.featureImportances.toArray()
    trees = np.array([t.featureImportances.toArray() for t in model.trees])
    order = sorted(range(len(names)), key=lambda i: (-whole[i], i))[:top]
    rows = [(rank + 1, names[i], float(whole[i]), float(trees[:, i].std())) for rank, i in enumerate(order)]
    return spark.createDataFrame(rows, "rank int, feature string, importance double, sd_over_trees double")


@dataclass
class Discriminant:
    """Two-class linear discriminant: class means and one pooled covariance.

    The data pass is one aggregate of sums and cross products; a features x features matrix
    is solved on the driver and scoring is a projection.
    """

    columns: list[str]
    slope: list[float]
    intercept: float

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], y: str = "y") -> Discriminant:
        columns = list(columns)
        d = len(columns)
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        # sums are taken around the overall mean, so large values do not cancel
        means = df.agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("m"))
        rows = df.withColumn("__m", means.scalar())
        x = [F.col(c) - F.col(f"__m.`{c}`") for c in columns]
        groups = rows.groupBy(F.col(y).alias("y")).agg(
            F.count(F.lit(1)).alias("n"),
            F.array(*[F.sum(v) for v in x]).alias("s"),
            F.array(*[F.sum(x[i] * x[j]) for i, j in pairs]).alias("ss"),
            F.array(*[F.first(F.col(f"__m.`{c}`")) for c in columns]).alias("m"),
        )
        found = {int(r["y"]): r for r in groups.collect()}
        n = sum(r["n"] for r in found.values())
        pooled = np.zeros((d, d))
        mean = {}
        for k, r in found.items():
            mean[k] = np.array(r["s"]) / r["n"]
            cross = np.zeros((d, d))
            for (i, j), v in zip(pairs, r["ss"], strict=True):
                cross[i, j] = cross[j, i] = v
            pooled += cross - r["n"] * np.outer(mean[k], mean[k])
        # population covariance within classes; a constant column gets no weight
        slope = np.linalg.pinv(pooled / n) @ (mean[1] - mean[0])
        centre = (mean[1] + mean[0]) / 2 + np.array(found[1]["m"])
        intercept = float(np.log(found[1]["n"] / found[0]["n"]) - centre @ slope)
        return cls(columns, [float(s) for s in slope], intercept)

    def log_odds(self) -> Column:
        total = F.lit(self.intercept)
        for c, s in zip(self.columns, self.slope, strict=True):
            total = total + F.col(c) * F.lit(s)
        return total

    def prob_case(self) -> Column:
        return 1 / (1 + F.exp(-self.log_odds()))


@dataclass
class NewtonLogistic:
    """Logistic regression by Newton steps, the penalty half the squared slopes over ``c`` against the summed log loss.

    The intercept is free. A step is one aggregate of the loss, the gradient and the second derivatives, features x
    features numbers in all; a step that would raise the loss is halved. Features may be any columns.
    """

    columns: Sequence[str]
    c: float = 1.0
    max_iter: int = 50
    tol: float = 1e-10
    weight: str | None = None

    def with_settings(self, **settings) -> NewtonLogistic:
        return replace(self, **settings)

    def coefficients(self, df: DataFrame) -> np.ndarray:
        """The intercept and the slope of each column."""
        columns = list(self.columns)
        x = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
        w = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        d = len(x)
        held = np.r_[0.0, np.ones(d - 1)] / self.c
        y = F.col("y").cast("double")
        pairs = [(i, j) for i in range(d) for j in range(i, d)]

        def at(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            z = reduce(lambda a, b: a + b, [xi * F.lit(float(b)) for xi, b in zip(x, beta, strict=True)])
            rows = df.select(*[xi.alias(f"x{i}") for i, xi in enumerate(x)], y.alias("y"), w.alias("w"), z.alias("z"))
            p = 1 / (1 + F.exp(-F.col("z")))
            rows = rows.withColumns({"r": F.col("w") * (p - F.col("y")), "v": F.col("w") * p * (1 - p)})
            # log(1 + e^z) - yz without overflow
            loss = F.col("w") * (F.greatest(F.col("z"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("z"))) - F.col("y") * F.col("z"))
            sums = [F.sum(loss), *[F.sum(F.col("r") * F.col(f"x{i}")) for i in range(d)]]
            sums += [F.sum(F.col("v") * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs]
            found = rows.agg(F.array(*sums)).first()[0]
            if found[0] is None:
                raise ValueError("no rows to learn from")
            second = np.zeros((d, d))
            for (i, j), s in zip(pairs, found[d + 1 :], strict=True):
                second[i, j] = second[j, i] = s
            return found[0] + 0.5 * (held * beta**2).sum(), np.array(found[1 : d + 1]) + held * beta, second + np.diag(held)

        beta = np.zeros(d)
        loss, slope, second = at(beta)
        for _ in range(self.max_iter):
            step = np.linalg.lstsq(second, slope, rcond=None)[0]
            while True:
                tried = beta - step
                found = at(tried)
                if found[0] <= loss + 1e-9 * abs(loss) or np.abs(step).max() < self.tol:
                    break
                step = step / 2
            beta, (loss, slope, second) = tried, found
            if np.abs(step).max() < self.tol:
                break
        return beta

    def fit(self, df: DataFrame) -> Fitted:
        beta = self.coefficients(df)

        def add(frame: DataFrame) -> DataFrame:
            z = F.lit(float(beta[0]))
            for c, b in zip(self.columns, beta[1:], strict=True):
                z = z + F.col(c) * F.lit(float(b))
            return _with_probability(frame, 1 / (1 + F.exp(-z)))

        return Fitted(add)


@dataclass
class VectorLogistic:
    """``NewtonLogistic`` over a feature vector."""

    n_features: int
    c: float = 1.0
    weight: str | None = None

    def with_settings(self, **settings) -> VectorLogistic:
        return replace(self, **settings)

    def fit(self, df: DataFrame) -> Fitted:
        names = [f"__f{i}" for i in range(self.n_features)]

        def wide(frame: DataFrame) -> DataFrame:
            return frame.withColumn("__x", vector_to_array("features")).withColumns({n: F.col("__x")[i] for i, n in enumerate(names)})

        fitted = NewtonLogistic(names, self.c, weight=self.weight).fit(wide(df))
        return Fitted(lambda frame: fitted.transform(wide(frame)).drop("__x", *names))


def gaussian_bayes_scores(train: DataFrame, df: DataFrame, columns: Sequence[str], y: str = "y", smoothing: float = 1e-9) -> DataFrame:
    """Gaussian naive Bayes log odds of case as one projection over one aggregate.

    ``smoothing`` times the largest overall variance is added to every variance.
    """
    columns = list(columns)
    is_case, is_control = F.col(y) == 1, F.col(y) == 0
    stats = [F.count_if(is_case).alias("n1"), F.count_if(is_control).alias("n0")]
    for c in columns:
        stats += [
            F.avg(F.when(is_case, F.col(c))).alias(f"m1_{c}"),
            F.avg(F.when(is_control, F.col(c))).alias(f"m0_{c}"),
            F.var_pop(F.when(is_case, F.col(c))).alias(f"v1_{c}"),
            F.var_pop(F.when(is_control, F.col(c))).alias(f"v0_{c}"),
        ]
    widest = [F.var_pop(c) for c in columns]
    eps = (F.greatest(*widest) if len(widest) > 1 else widest[0]) * smoothing
    fitted = train.agg(*stats, eps.alias("eps"))
    rows = df.withColumn("__s", fitted.select(F.struct("*")).scalar())

    def log_density(c: str, k: int) -> Column:
        m, v = F.col(f"__s.`m{k}_{c}`"), F.col(f"__s.`v{k}_{c}`") + F.col("__s.eps")
        return -0.5 * F.ln(2 * F.pi() * v) - F.pow(F.col(c) - m, F.lit(2)) / (2 * v)

    odds = F.ln(F.col("__s.n1") / F.col("__s.n0"))
    for c in columns:
        odds = odds + log_density(c, 1) - log_density(c, 0)
    return rows.withColumn("log_odds", odds).drop("__s")


def nearest_neighbours(
    train: DataFrame,
    query: DataFrame,
    key: str,
    vector: str,
    label: str,
    k: int = 5,
    block_rows: int = 4096,
    skip_self: bool = False,
    digits: int = 6,
    pivots: int = 16,
    report: dict | None = None,
) -> DataFrame:
    """(key, neighbour, rank, distance2, label): exact k nearest train rows per query row.

    See ``weaklabel.operators.neighbours``; ``report`` gets the numbers of block pairs, and of those compared.
    Ties in the squared distance (rounded to ``digits``) go to the smaller neighbour key.
    """
    found, pairs = nearest(
        train.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("label")),
        query.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")),
        k, block_rows, skip_self, digits, pivots,
    )
    log.info("neighbours: %s of %s block pairs compared", pairs["compared"], pairs["all"])
    if report is not None:
        report.update(pairs)
    return found.select(F.col("q").alias(key), F.col("t").alias("neighbour"), "rank", "distance2", "label")


def neighbour_vote(neighbours: DataFrame, key: str) -> DataFrame:
    """Most common neighbour label; ties go to the smaller label."""
    counts = neighbours.groupBy(key, "label").agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by("label", F.struct(F.col("n"), -F.col("label")))
    return counts.groupBy(key).agg(best.alias("predicted"), F.max("n").alias("n_votes"))


def _in_threads(spark: SparkSession, parallelism: int, jobs: list[Callable]) -> list:
    """Run independent driver-side steps at the same time, each under its own Spark job group."""
    if parallelism <= 1 or len(jobs) <= 1:
        return [job() for job in jobs]
    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(lambda job: inheritable_thread_target(spark)(job)(), jobs))


def screen(
    df: DataFrame,
    models: Mapping,
    key: str,
    k: int = 5,
    seed: int = SEED,
    regression: bool = False,
    parallelism: int = 4,
) -> DataFrame:
    """(model, fold, metric, value) of k-fold cross-validation for several models: Spark
    estimators or anything else whose ``fit`` gives a ``transform`` that adds their columns.

    The frame is written once, as ranking reads it several times, and so is it with its fold column, to the shared
    folder: a lost executor costs no recomputation. It is kept for all fits, which run side by side, each with what its model does to be
    ready to predict (neighbours are found then).
    The held-out predictions of all models and folds then go through one aggregate.
    """
    folds = cut_lineage(kfold(written(df, "screened-rows"), key, k, seed)).persist()
    part = lambda f, same: folds.where(F.col("fold") == f if same else F.col("fold") != f)
    pairs = [(name, f) for name in models for f in range(1, k + 1)]
    jobs = [lambda n=n, f=f: models[n].fit(part(f, False)).transform(part(f, True)) for n, f in pairs]
    held = []
    for (name, _), out in zip(pairs, _in_threads(df.sparkSession, parallelism, jobs), strict=True):
        columns = [F.lit(name).alias("name"), "fold", F.col("y").cast("double").alias("y"), F.col("prediction").alias("p")]
        prob = F.lit(None).cast("double") if regression else vector_to_array("probability")[1]
        held.append(out.select(*columns, prob.alias("prob")))
    scored = reduce(DataFrame.unionByName, held).persist()
    error = F.avg(F.pow(F.col("y") - F.col("p"), F.lit(2)))
    if regression:
        out = scored.groupBy("name", "fold").agg((-error).alias("neg_mse"))
        values = ["neg_mse"]
    else:
        ranks = auc_of_scores(scored, "y", ["prob"], ["name", "fold"]).select("name", "fold", F.col("auc").alias("roc_auc"))
        flat = fold_metrics(scored, ["name", "fold"], "y", "p").withColumn("neg_mse", -F.col("mse"))
        out = flat.select("name", "fold", "f1", "neg_mse").join(ranks, ["name", "fold"], "left")
        values = ["f1", "neg_mse", "roc_auc"]
    long = out.unpivot(["name", "fold"], values, "metric", "value").withColumnRenamed("name", "model")
    # models x folds x metrics numbers: small and final, so the kept frames can go
    result = df.sparkSession.createDataFrame(long.collect(), "model string, fold int, metric string, value double")
    scored.unpersist()
    folds.unpersist()
    return result


def _with_settings(learner, settings: Mapping, weight: str | None):
    """A Spark estimator or a learner of this package with ``settings`` and, if given, a weight column."""
    if isinstance(learner, Estimator):
        weights = {learner.getParam("weightCol"): weight} if weight else {}
        return learner.copy({learner.getParam(k): v for k, v in settings.items()} | weights)
    return learner.with_settings(**settings, **({"weight": weight} if weight else {}))


def _takes_weights(learner) -> bool:
    return learner.hasParam("weightCol") if isinstance(learner, Estimator) else hasattr(learner, "weight")


def nested_folds(df: DataFrame, key: str, k_outer: int, k_inner: int, seed: int = SEED) -> DataFrame:
    """``df`` with an outer and an inner fold, written once for all fits.

    Inner folds deal the rows of each outer fold in hash order, so those of any outer training part, the other outer
    folds together, are of near equal size too: one table of folds serves every fit. Ranking reads its rows several
    times, so what it reads is written before.
    """
    folds = written(kfold(written(df, "nested-rows"), key, k_outer, seed, fold="outer"), "outer-folds")
    ranked = hash_rank(folds, key, seed + 1, within=["outer"], rank="__rank")
    return cut_lineage(ranked.withColumn("inner", (F.pmod(F.col("__rank") - 1, F.lit(k_inner)) + 1).cast("int")).drop("__rank"))


def nested_cv(
    df: DataFrame,
    estimator,
    grid: Mapping[str, Sequence],
    key: str,
    name: str,
    task: str = "class",
    weight: str | None = None,
    k_outer: int = 10,
    k_inner: int = 3,
    seed: int = SEED,
    parallelism: int = 4,
    class_weights: Sequence = (None,),
    store=None,
) -> DataFrame:
    """Nested cross-validation: (model, params, fold, metric, value) per outer fold.

    ``estimator`` is a Spark estimator or a learner of this package. Inner folds pick the setting (F1 for classes,
    squared error for ``regression`` and ``log_regression``), the pick is refitted on the outer training part and judged
    on the outer test part. Class weights are those of the rows that a fit sees. All fits of all outer folds wait in one
    queue for ``parallelism`` workers; the refit of a fold follows the last of its inner fits, while those of others run.
    ``store`` (a ResultStore) keeps the inner scores of each setting and the outer scores of each fold: a run of the same
    grid, folds, seed and task starts where the last one ended.
    """
    weighs = weight is not None or any(cw is not None for cw in class_weights)
    if weighs and not _takes_weights(estimator):
        raise ValueError(f"{type(estimator).__name__} takes no row weights")
    tried = [(dict(zip(grid, values, strict=True)), cw) for cw in class_weights for values in itertools.product(*grid.values())]
    log.info("%s: %s fits", name, k_outer * (k_inner * len(tried) + 1))
    run = json.dumps([{k: list(v) for k, v in grid.items()}, k_outer, k_inner, seed, task, weight, [str(c) for c in class_weights]], sort_keys=True)
    spark = df.sparkSession
    folds = nested_folds(df, key, k_outer, k_inner, seed).persist()
    regression = task != "class"
    if regression:
        evaluator = RegressionEvaluator(labelCol="y", metricName="mse")
    else:
        evaluator = MulticlassClassificationEvaluator(labelCol="y", metricName="fMeasureByLabel", metricLabel=1.0)
    schema = "model string, params string, fold int, metric string, value double, run string"
    text = [json.dumps(s | ({} if "class_weight" in s else {"class_weight": str(cw)}), sort_keys=True) for s, cw in tried]

    done, inner = set(), {}
    if store is not None:
        kept = store.load().where(F.col("model") == name)
        done = {r["fold"] for r in kept.where(F.col("run") == run).select("fold").distinct().collect()}
        inner = {(r["fold"], r["params"], r["metric"]): r["value"] for r in kept.where(F.col("run") == f"{run}|inner").collect()}

    def fit(rows: DataFrame, setting: Mapping, cw):
        # the forests of this package weigh classes themselves, by each tree's own draw
        return _with_settings(estimator, setting, "w" if weighs else None).fit(with_class_weight(rows, cw, weight, "w"))

    def judged(f: int, i: int, g: int) -> float:
        part = folds.where(F.col("outer") != f)
        model = fit(part.where(F.col("inner") != g), *tried[i])
        return evaluator.evaluate(model.transform(part.where(F.col("inner") == g)))

    def refitted(f: int, best: int) -> DataFrame:
        model = fit(folds.where(F.col("outer") != f), *tried[best])
        held = model.transform(folds.where(F.col("outer") == f))
        if regression:
            p, y = class_of_regression("prediction", "y", task == "log_regression")
        else:
            p, y = F.col("prediction").cast("int"), F.col("y").cast("int")
        m = fold_metrics(held.select(F.lit(f).alias("fold"), y.alias("yy"), p.alias("pp")), ["fold"], "yy", "pp").first()
        rows = spark.createDataFrame([(name, text[best], f, metric, m[metric], run) for metric in ("acc", "f1", "mse", "auc")], schema)
        if store is not None:
            store.append(rows, f"{name}|{run}|{f}")
        return rows

    scores = {(f, i, g): inner.get((f, text[i], f"inner_{g}")) for f in range(1, k_outer + 1) if f not in done for i in range(len(tried)) for g in range(1, k_inner + 1)}
    produced, waiting = [], {}

    def settle(pool, f: int) -> None:
        """Refit fold ``f`` once nothing of it is open."""
        own = {k: v for k, v in scores.items() if k[0] == f}
        if all(v is not None for v in own.values()):
            means = [float(np.mean([own[f, i, g] for g in range(1, k_inner + 1)])) for i in range(len(tried))]
            best = int(np.argmin(means) if regression else np.argmax(means))
            waiting[pool.submit(inheritable_thread_target(spark)(refitted), f, best)] = None

    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        for spot, value in scores.items():
            if value is None:
                waiting[pool.submit(inheritable_thread_target(spark)(judged), *spot)] = spot
        for f in {k[0] for k, v in scores.items()} - {s[0] for s in waiting.values() if s}:
            settle(pool, f)
        while waiting:
            for future in wait(waiting, return_when=FIRST_COMPLETED).done:
                spot = waiting.pop(future)
                if spot is None:
                    produced.append(future.result())
                    continue
                scores[spot] = future.result()
                f, i, _ = spot
                own = [scores[f, i, g] for g in range(1, k_inner + 1)]
                if store is not None and None not in own:
                    rows = [(name, text[i], f, f"inner_{g}", v, f"{run}|inner") for g, v in enumerate(own, 1)]
                    store.append(spark.createDataFrame(rows, schema), f"{name}|{run}|{f}|{text[i]}")
                settle(pool, f)
    folds.unpersist()
    if store is not None:
        return store.load().where((F.col("model") == name) & (F.col("run") == run)).drop("run")
    return reduce(DataFrame.unionByName, produced).drop("run")


def sensitivity_variants(
    train: DataFrame,
    score_on: DataFrame,
    make: Callable[[str | None], Estimator],
    targets: Mapping[str, str],
    weight: str,
    key: str,
) -> DataFrame:
    """Wide table of probabilities for target x weighting: ``<target>_weighted_prob`` and
    ``<target>_unweighted_prob`` next to the key. Each model adds a projection; a forest that is
    left in its table adds a join by the features."""
    out = score_on
    for name, target in targets.items():
        rows = train.withColumn("y", F.col(target).cast("double"))
        for label, column in (("weighted", weight), ("unweighted", None)):
            model = make(column).fit(rows)
            out = score(model, out, f"{name}_{label}_prob", f"__{name}_{label}")
    return out.select(key, *sensitivity_names(targets))


def sensitivity_names(targets: Iterable[str]) -> list[str]:
    return [f"{n}_{w}_prob" for n in targets for w in ("weighted", "unweighted")]
