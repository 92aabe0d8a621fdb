"""Learners over the orders table with planted rules, so that SQL can say what a right learner must find.

Feature ``a`` is the order priority (1 to 5), ``b`` is the customer number modulo 7. The planted class is ``a <= 2``: a tree,
a forest or a discriminant that works finds exactly that rule, one that is broken does not.
"""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import DataFrame, SparkSession, functions as F

from weaklabel.catalog.registry import query
from weaklabel.operators.evaluate import fold_summary
from weaklabel.operators.features import assemble
from weaklabel.operators.forest import ForestLearner
from weaklabel.operators.models import (
    DiscriminantLearner,
    NewtonLogistic,
    classifiers,
    feature_importance,
    forest_classifier,
    forest_regressor,
    nested_cv,
    perceptron,
    score,
    screen,
    sensitivity_variants,
    with_class_weight,
)
from weaklabel.operators.network import NetworkLearner
from weaklabel.sources.tables import scan

_PLANTED_SQL = """
WITH t AS (SELECT o_orderkey AS unit_id, substr(o_orderpriority, 1, 1)::INT AS a, o_custkey % 7 AS b, o_totalprice AS price FROM orders)
"""


def planted(spark: SparkSession, folder: str, y=None, columns: tuple[str, ...] = ("a", "b")) -> DataFrame:
    rows = scan(spark, folder, "orders").select(
        F.col("o_orderkey").alias("unit_id"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("a"),
        (F.col("o_custkey") % 7).cast("double").alias("b"),
        F.col("o_totalprice").alias("price"),
        F.col("o_custkey").alias("owner"),
    )
    rows = rows.withColumn("y", (F.col("a") <= 2).cast("int") if y is None else y)
    rows = rows.withColumns({"weight": 1 + F.col("b") / 10, "far": F.col("y") * 10 + F.col("b") / 10})
    return assemble(rows, list(columns))


def _tree(depth: int = 1) -> DecisionTreeClassifier:
    return classifiers(2, depth=depth)["CART"]


_SCORED_SQL = _PLANTED_SQL + "SELECT unit_id, (a <= 2)::INT AS predicted, round((a <= 2)::INT::DOUBLE, 6) AS prob FROM t"


@query("M4 M16", _SCORED_SQL)
def planted_tree(spark: SparkSession, folder: str) -> DataFrame:
    rows = planted(spark, folder)
    return score(_tree().fit(rows), rows).select("unit_id", "predicted", F.round("prob", 6).alias("prob"))


@query("M5 M15 M16", _SCORED_SQL)
def planted_forest(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_class_weight(planted(spark, folder), {0: 0.99, 1: 0.01}, "weight", "w")
    model = forest_classifier(trees=9, depth=1, weight="w").fit(rows)
    return score(model, rows).select("unit_id", "predicted", F.round("prob", 6).alias("prob"))


@query(
    "M18 F4",
    _PLANTED_SQL
    + """
SELECT CAST(row_number() OVER (ORDER BY tells DESC) AS INT) AS rank, feature, tells::DOUBLE AS importance, 0.0::DOUBLE AS sd_over_trees FROM (
  SELECT 'a' AS feature, (count(DISTINCT CASE WHEN a <= 2 THEN a END) + count(DISTINCT CASE WHEN a > 2 THEN a END) = count(DISTINCT a))::INT AS tells FROM t
  UNION ALL
  SELECT 'b', (count(DISTINCT CASE WHEN a <= 2 THEN b END) + count(DISTINCT CASE WHEN a > 2 THEN b END) = count(DISTINCT b))::INT FROM t)
""",
)
def planted_importance(spark: SparkSession, folder: str) -> DataFrame:
    model = forest_classifier(trees=9, depth=1).fit(planted(spark, folder))
    return feature_importance(model, ["a", "b"], top=2)


@query(
    "M9 L9 M16",
    _PLANTED_SQL
    + """,
u AS (SELECT unit_id, a <= 2 AS low, CASE WHEN a <= 2 THEN 1.0::DOUBLE ELSE 3.0::DOUBLE END + price / 1000000 AS y FROM t),
m AS (SELECT low, avg(y) AS mean FROM u GROUP BY low)
SELECT unit_id, round(exp(mean), 4) AS prob FROM u JOIN m ON u.low = m.low
""",
)
def planted_step(spark: SparkSession, folder: str) -> DataFrame:
    """One tree over all rows finds the step, and its leaves are the group means."""
    target = F.when(F.col("a") <= 2, 1.0).otherwise(3.0) + F.col("price") / 1000000
    rows = planted(spark, folder, target)
    return score(forest_regressor(trees=1, depth=1).setBootstrap(False).fit(rows), rows, log_scale=True).select("unit_id", F.round("prob", 4).alias("prob"))


@query(
    "M1 M16",
    """
SELECT count(*) AS n, round(avg(CASE WHEN (o_custkey + o_orderkey) % 3 = 0 THEN 1.0::DOUBLE ELSE 0 END), 3) AS mean_prob FROM orders
""",
)
def logistic_mean(spark: SparkSession, folder: str) -> DataFrame:
    """With an intercept that is not held back, the mean probability is the event rate."""
    rows = planted(spark, folder, ((F.col("owner") + F.col("unit_id")) % 3 == 0).cast("int"))
    scored = score(classifiers(2)["LR"].fit(rows), rows)
    return scored.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("prob"), 3).alias("mean_prob"))


@query("M7 M16", _PLANTED_SQL + "SELECT (a <= 2)::INT AS y, (a <= 2)::INT AS predicted, count(*) AS n FROM t GROUP BY ALL")
def network_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Two groups far apart must be told apart whole."""
    rows = planted(spark, folder, columns=("far", "b"))
    scored = score(perceptron([2, 4, 2], max_iter=100).fit(rows), rows)
    return scored.groupBy("y", "predicted").agg(F.count(F.lit(1)).alias("n"))


def _newton_sql(steps: int) -> str:
    """Newton steps for an intercept and one slope with the penalty on the slope, unrolled."""
    parts = [_PLANTED_SQL.strip() + ",\nu AS (SELECT a::DOUBLE AS x, (a + b > 5)::INT AS y FROM t),\nb0 AS (SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1)"]
    for k in range(steps):
        parts.append(
            f"""g{k} AS MATERIALIZED (SELECT sum(p - y) AS g0, sum((p - y) * x) + any_value(b1) AS g1, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * x) AS h01,
  sum(p * (1 - p) * x * x) + 1 AS h11, any_value(b0) AS b0, any_value(b1) AS b1 FROM (SELECT x, y, b0, b1, 1 / (1 + exp(-(b0 + b1 * x))) AS p FROM u, b{k})),
b{k + 1} AS MATERIALIZED (SELECT b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS b0, b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b1 FROM g{k})"""
        )
    return ",\n".join(parts) + f"\nSELECT unnest(['intercept', 'a']) AS term, round(unnest([b0, b1]), 6) AS coefficient FROM b{steps}"


@query("M1", _newton_sql(12))
def logistic_coefficients(spark: SparkSession, folder: str) -> DataFrame:
    """Coefficients of a penalised logistic regression whose penalty does not touch the intercept."""
    rows = planted(spark, folder, (F.col("a") + F.col("owner") % 7 > 5).cast("int"))
    found = [float(b) for b in NewtonLogistic(["a"]).coefficients(rows)]
    return spark.createDataFrame(list(zip(["intercept", "a"], found, strict=True)), "term string, coefficient double").withColumn("coefficient", F.round("coefficient", 6))


@query("M7 M10 M16", "SELECT count(*) AS n, count(*) AS n_close FROM orders")
def network_line(spark: SparkSession, folder: str) -> DataFrame:
    """A network without hidden layers is a line: it must find a planted one for every row."""
    rows = planted(spark, folder, 2 * F.col("a") - F.col("owner") % 7 + 3)
    learner = NetworkLearner(hidden=(), activation="identity", alpha=0.0, rate=0.3, max_iter=250, regression=True, patience=250)
    scored = learner.fit(rows).transform(rows)
    return scored.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("prediction") - F.col("y")) < 0.05).alias("n_close"))


_CUT_SQL = """
WITH t AS (SELECT o_totalprice AS v, CASE WHEN o_totalprice > 200000 THEN o_custkey % 3 = 0 ELSE o_custkey % 3 <> 0 END::INT AS y FROM orders),
c AS (SELECT v, count(*) AS n, sum(y) AS q FROM t GROUP BY v),
r AS (SELECT v, lead(v) OVER o AS next, sum(n) OVER o::DOUBLE AS s, sum(q) OVER o::DOUBLE AS q, sum(n) OVER ()::DOUBLE AS all_s, sum(q) OVER ()::DOUBLE AS all_q
      FROM c WINDOW o AS (ORDER BY v)),
g AS (SELECT v, next, (q * q + (s - q) * (s - q)) / s + ((all_q - q) * (all_q - q) + (all_s - s - all_q + q) * (all_s - s - all_q + q)) / (all_s - s)
      - (all_q * all_q + (all_s - all_q) * (all_s - all_q)) / all_s AS gain FROM r WHERE next IS NOT NULL)
SELECT round(v + (next - v) / 2, 6) AS threshold, round(gain, 3) AS gain, (SELECT count(*) FROM c) AS n_values FROM g ORDER BY round(gain, 9) DESC, v LIMIT 1
"""


@query("M4 M5 M9", _CUT_SQL)
def exact_first_cut(spark: SparkSession, folder: str) -> DataFrame:
    """The best cut over every distinct price, found by aggregates: the bound on a task's rows is set under the table's."""
    owner = F.col("owner") % 3
    rows = planted(spark, folder, F.when(F.col("price") > 200000, owner == 0).otherwise(owner != 0).cast("int"), columns=("price",))
    model = ForestLearner(trees=1, depth=1, bootstrap=False, key="unit_id", local_cells=2).fit(rows)
    gain = float(model.trees[0].gains.sum())
    return rows.agg(F.count_distinct("price").alias("n_values")).select(
        F.round(F.lit(float(model.trees[0].threshold)), 6).alias("threshold"), F.round(F.lit(gain), 3).alias("gain"), "n_values"
    )


@query(
    "M4 M5 M15",
    "SELECT DISTINCT o_custkey % 41 AS v, ((o_custkey % 41) % 2)::INT AS predicted, TRUE AS deeper_than_30 FROM orders",
)
def deep_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Stripes of falling weight are best cut off one by one: only a tree of some 40 levels tells them all."""
    v = F.col("owner") % 41
    rows = planted(spark, folder, (v % 2).cast("int")).withColumns({"v": v.cast("double"), "fall": F.pow(F.lit(0.5), v)}).drop("features")
    rows = assemble(rows, ["v"])
    model = ForestLearner(trees=1, depth=None, bootstrap=False, weight="fall", key="unit_id").fit(rows)
    scored = score(model, rows).select(F.col("v").cast("long").alias("v"), "predicted").distinct()
    return scored.withColumn("deeper_than_30", F.lit(model.trees[0].depth > 30))


@query(
    "M10 M14 D5 H4",
    _PLANTED_SQL
    + """,
best AS (SELECT min((a <= 2)::INT) = 0 AND max((a <= 2)::INT) = 1 AS told FROM t)
SELECT model, metric, CASE WHEN metric = 'neg_mse' THEN 0.0 ELSE 1.0 END::DOUBLE AS mean, 0.0::DOUBLE AS sd, 5::BIGINT AS n_folds, 0::BIGINT AS n_skipped
FROM (SELECT unnest(['CART', 'LDA']) AS model) x, (SELECT unnest(['f1', 'neg_mse', 'roc_auc']) AS metric) y, best WHERE told
""",
)
def planted_screening(spark: SparkSession, folder: str) -> DataFrame:
    """Both kinds of learners, Spark's and this package's own, through one screening: no fold may err."""
    found = fold_summary(screen(planted(spark, folder), {"CART": _tree(), "LDA": DiscriminantLearner(2)}, "unit_id"))
    return found.select("model", "metric", F.round(F.col("mean") + 0.0, 9).alias("mean"), F.round("sd", 9).alias("sd"), "n_folds", "n_skipped")


@query(
    "M11 M12 M13",
    _PLANTED_SQL
    + """,
best AS (SELECT min((a <= 2)::INT) = 0 AND max((a <= 2)::INT) = 1 AS told FROM t)
SELECT 'CART' AS model, '{"class_weight": "None", "maxDepth": 1}' AS params, fold::INT AS fold, metric,
       CASE WHEN metric = 'mse' THEN 0.0 ELSE 1.0 END::DOUBLE AS value
FROM (SELECT unnest(range(1, 6)) AS fold) f, (SELECT unnest(['acc', 'f1', 'mse', 'auc']) AS metric) m, best WHERE told
""",
)
def planted_nested_cv(spark: SparkSession, folder: str) -> DataFrame:
    """Depth 0 can't find the rule and depth 1 can: the inner folds must pick it in every outer fold."""
    return nested_cv(planted(spark, folder), _tree(), {"maxDepth": [0, 1]}, "unit_id", "CART", k_outer=5, k_inner=2)


@query(
    "M17 L3 L4",
    _PLANTED_SQL
    + """
SELECT unit_id, (a <= 2)::INT::DOUBLE AS two_weighted_prob, (a <= 2)::INT::DOUBLE AS two_unweighted_prob,
       (a <= 3)::INT::DOUBLE AS three_weighted_prob, (a <= 3)::INT::DOUBLE AS three_unweighted_prob FROM t
""",
)
def planted_sensitivity(spark: SparkSession, folder: str) -> DataFrame:
    rows = planted(spark, folder).withColumns({"two": F.col("y"), "three": (F.col("a") <= 3).cast("int")}).drop("y")
    make = lambda w: forest_classifier(trees=5, depth=1, weight=w)
    return sensitivity_variants(rows, rows.drop("weight"), make, {"two": "two", "three": "three"}, "weight", "unit_id")
