"""Metrics, curves and review tables over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weaklabel.catalog import views
from weaklabel.catalog.registry import query
from weaklabel.catalog.views import r6
from weaklabel.functions.ranking import hash_rank
from weaklabel.functions.rounding import round_half_even
from weaklabel.operators.cohort import map_values
from weaklabel.operators.evaluate import (
    adjudicated_set,
    auc_of_scores,
    base_rate_accuracy,
    class_of_regression,
    class_report,
    cohort_export,
    confusion,
    confusion_of_prediction,
    disagreement_segment,
    dot_plot_table,
    fold_metrics,
    metrics,
    missed_zero_cases,
    pr_curve,
    review_counts,
    roc_curve,
    threshold_sweep,
    two_score_prediction,
)
from weaklabel.sources.tables import scan

METRICS = ("accuracy", "precision", "recall", "specificity", "f1", "auc")
SCORES = ["p_value", "p_cents"]
THRESHOLDS = (0.5, 0.7, 0.8, 0.9)


def _cells_sql(source: str, y: str, scores, thresholds) -> str:
    parts = [
        f"SELECT '{m}' AS model, {t}::DOUBLE AS threshold, count(*) FILTER ({m} >= {t} AND {y} = 1) AS tp, "
        f"count(*) FILTER ({m} >= {t} AND {y} = 0) AS fp, count(*) FILTER ({m} < {t} AND {y} = 0) AS tn, "
        f"count(*) FILTER ({m} < {t} AND {y} = 1) AS fn FROM {source}"
        for m in scores
        for t in thresholds
    ]
    return " UNION ALL ".join(parts)


_METRIC_SQL = """
round(CASE WHEN tp + fp + tn + fn = 0 THEN NULL ELSE (tp + tn) / (tp + fp + tn + fn) END, 6) AS accuracy,
round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision,
round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
round(CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END, 6) AS specificity,
round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1,
round(CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / (tp + fn) + tn / (tn + fp)) / 2 END, 6) AS auc
"""


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in (names or METRICS)})


@query("N1", "WITH " + views.EVENT_SCORES_SQL + _cells_sql("event_scores", "y", SCORES, THRESHOLDS))
def confusion_counts(spark: SparkSession, folder: str) -> DataFrame:
    return confusion(views.event_scores(spark, folder), "y", SCORES, THRESHOLDS)


@query(
    "N2 N3 N4 N5 N6 N9 N12",
    "WITH "
    + views.DOC_SCORED_SQL
    + ", cells AS ("
    + _cells_sql("doc_scored", "gold", ["p_majority", "p_model"], THRESHOLDS)
    + f") SELECT *, {_METRIC_SQL} FROM cells",
)
def threshold_sweep_table(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(threshold_sweep(views.doc_scored(spark, folder), "gold", ["p_majority", "p_model"], THRESHOLDS))


@query(
    "B19 N6",
    "WITH "
    + views.DOC_SCORED_SQL
    + """, cells AS (
  SELECT count(*) FILTER (hit AND gold = 1) AS tp, count(*) FILTER (hit AND gold = 0) AS fp,
         count(*) FILTER (NOT hit AND gold = 0) AS tn, count(*) FILTER (NOT hit AND gold = 1) AS fn
  FROM (SELECT gold, p_majority >= 0.7 AND p_model >= 0.3 AS hit FROM doc_scored))
SELECT tp, fp, tn, fn, """
    + _METRIC_SQL
    + " FROM cells",
)
def two_threshold_quality(spark: SparkSession, folder: str) -> DataFrame:
    rule = two_score_prediction({"p_majority": 0.7, "p_model": 0.3})
    return _rounded(metrics(confusion_of_prediction(views.doc_scored(spark, folder).withColumn("hit", rule), "gold", "hit")))


@query(
    "N7",
    "WITH "
    + views.DOC_SCORED_SQL
    + """
SELECT round(avg((gold - p_model) * (gold - p_model)), 6) AS mse_model,
       round(avg((gold - p_majority) * (gold - p_majority)), 6) AS mse_majority
FROM doc_scored
""",
)
def mean_squared_error(spark: SparkSession, folder: str) -> DataFrame:
    square = lambda c: F.avg(F.pow(F.col("gold") - F.col(c), F.lit(2)))
    return views.doc_scored(spark, folder).agg(
        r6(square("p_model")).alias("mse_model"), r6(square("p_majority")).alias("mse_majority")
    )


_COUNTS_SQL = """,
long AS (SELECT 'p_value' AS model, p_value AS score, y FROM event_scores
         UNION ALL SELECT 'p_cents', p_cents, y FROM event_scores),
points AS (SELECT model, score, count(*) FILTER (y = 1) AS n_case, count(*) FILTER (y = 0) AS n_control FROM long GROUP BY model, score),
ranked AS (
  SELECT *, sum(n_case) OVER up AS cum_case, sum(n_control) OVER up AS cum_control,
         sum(n_case) OVER (PARTITION BY model) AS all_case, sum(n_control) OVER (PARTITION BY model) AS all_control,
         row_number() OVER (PARTITION BY model ORDER BY score DESC) AS pos,
         lead(n_case) OVER (PARTITION BY model ORDER BY score DESC) AS next_case,
         lead(n_control) OVER (PARTITION BY model ORDER BY score DESC) AS next_control
  FROM points WINDOW up AS (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
"""


@query(
    "N8",
    "WITH "
    + views.EVENT_SCORES_SQL
    + _COUNTS_SQL
    + """
SELECT model, round(sum(n_case * (all_control - cum_control + n_control / 2)) / (max(all_case) * max(all_control)), 6) AS auc
FROM ranked GROUP BY model
""",
)
def rank_auc(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(auc_of_scores(views.event_scores(spark, folder), "y", SCORES), "auc")


_ROC_SQL = """
SELECT model, round(score, 6) AS threshold, round(cum_control / all_control, 6) AS fpr, round(cum_case / all_case, 6) AS tpr
FROM ranked {where}
UNION ALL SELECT * FROM (VALUES ('p_value', NULL::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), ('p_cents', NULL, 0.0, 0.0))
"""


@query("N10", "WITH " + views.EVENT_SCORES_SQL + _COUNTS_SQL + _ROC_SQL.format(where=""))
def roc_curve_points(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(roc_curve(views.event_scores(spark, folder), "y", SCORES), "threshold", "fpr", "tpr")


@query(
    "N10",
    "WITH "
    + views.EVENT_SCORES_SQL
    + _COUNTS_SQL
    + _ROC_SQL.format(where="WHERE pos = 1 OR next_case IS NULL OR next_case <> n_case OR next_control <> n_control"),
)
def roc_curve_corners(spark: SparkSession, folder: str) -> DataFrame:
    curve = roc_curve(views.event_scores(spark, folder), "y", SCORES, drop_collinear=True)
    return _rounded(curve, "threshold", "fpr", "tpr")


@query(
    "N11",
    "WITH "
    + views.EVENT_SCORES_SQL
    + _COUNTS_SQL
    + """
SELECT model, round(score, 6) AS threshold, round(cum_case / (cum_case + cum_control), 6) AS precision,
       round(cum_case / all_case, 6) AS recall
FROM ranked
UNION ALL SELECT * FROM (VALUES ('p_value', NULL::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE), ('p_cents', NULL, 1.0, 0.0))
""",
)
def precision_recall_points(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(pr_curve(views.event_scores(spark, folder), "y", SCORES), "threshold", "precision", "recall")


_REPORT_SQL = """
, p AS (SELECT *, tp + fp + tn + fn AS n, tn + fp AS n0, tp + fn AS n1,
    tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, 2 * tn / (2 * tn + fn + fp) AS f0,
    tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, 2 * tp / (2 * tp + fp + fn) AS f1 FROM cells)
SELECT '0' AS class, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, n0 AS support FROM p
UNION ALL SELECT '1', round(p1, 6), round(r1, 6), round(f1, 6), n1 FROM p
UNION ALL SELECT 'accuracy', round((tp + tn) / n, 6), round((tp + tn) / n, 6), round((tp + tn) / n, 6), n FROM p
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), n FROM p
UNION ALL SELECT 'weighted avg', round((p0 * n0 + p1 * n1) / n, 6), round((r0 * n0 + r1 * n1) / n, 6),
                 round((f0 * n0 + f1 * n1) / n, 6), n FROM p
"""


@query(
    "N13", "WITH " + views.EVENT_SCORES_SQL + ", cells AS (" + _cells_sql("event_scores", "y", ["p_value"], [0.1]) + ")" + _REPORT_SQL
)
def classification_report(spark: SparkSession, folder: str) -> DataFrame:
    cells = confusion(views.event_scores(spark, folder), "y", ["p_value"], [0.1])
    return _rounded(class_report(cells), "precision", "recall", "f1")


@query(
    "N14 B15",
    "WITH "
    + views.EVENT_SCORES_SQL
    + """, cells AS (
  SELECT count(*) FILTER (event_type = 'error' AND big = 1) AS tp, count(*) FILTER (event_type = 'error' AND big = 0) AS fp,
         count(*) FILTER (event_type <> 'error' AND big = 0) AS tn, count(*) FILTER (event_type <> 'error' AND big = 1) AS fn
  FROM (SELECT event_type, CASE WHEN value > 100 THEN 1 ELSE 0 END AS big FROM event_scores))
SELECT tp, fp, tn, fn, """
    + _METRIC_SQL
    + " FROM cells",
)
def baseline_comparator(spark: SparkSession, folder: str) -> DataFrame:
    rows = scan(spark, folder, "events").select(
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("guess"),
        F.when(F.col("value") > 100, 1).otherwise(0).alias("y"),
    )
    return _rounded(metrics(confusion_of_prediction(rows, "y", "guess")))


@query("N15", "WITH " + views.EVENT_SCORES_SQL + "SELECT round(1 - avg(y), 6) AS base_rate_accuracy FROM event_scores")
def base_rate(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(base_rate_accuracy(views.event_scores(spark, folder), "y"), "base_rate_accuracy")


@query(
    "N16",
    "WITH "
    + views.EVENT_SCORES_SQL
    + """
SELECT 'p_value' AS model, count(*) FILTER (p_value = 0 AND y = 1) AS n_missed FROM event_scores
UNION ALL SELECT 'p_cents', count(*) FILTER (p_cents = 0 AND y = 1) FROM event_scores
""",
)
def missed_zero_scores(spark: SparkSession, folder: str) -> DataFrame:
    return missed_zero_cases(views.event_scores(spark, folder), "y", SCORES)


_REVIEW_SQL = """,
reviewed AS (SELECT d.doc_id AS unit_id, d.source AS grid,
                    CASE WHEN b.item_id IS NOT NULL THEN 1.0::DOUBLE ELSE (1 - l.quality)::DOUBLE END AS outcome,
                    CASE WHEN b.item_id IS NOT NULL THEN 0.0::DOUBLE WHEN l.toxic = 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS agreement
             FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN benchmark b ON d.doc_id = b.item_id),
final AS (SELECT r.*, s.p_model, s.p_majority FROM reviewed r LEFT JOIN doc_scored s ON r.unit_id = s.unit_id AND r.grid = s.owner_id
          WHERE r.outcome IS NOT NULL)
"""


def _final_set(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = scan(spark, folder, "documents").select(F.col("doc_id").alias("unit_id"), F.col("source").alias("grid"))
    gold = scan(spark, folder, "labels").select(
        F.col("doc_id").alias("unit_id"),
        (1 - F.col("quality")).cast("double").alias("outcome"),
        F.when(F.col("toxic") == 1, 0.5).otherwise(1.0).alias("agreement"),
    )
    reviewed = docs.join(gold, "unit_id", "left").withColumn("agreement", F.coalesce("agreement", F.lit(1.0)))
    scored = views.doc_scored(spark, folder).select("unit_id", F.col("owner_id").alias("grid"), "p_model", "p_majority")
    overrides = scan(spark, folder, "benchmark").select(
        F.col("item_id").alias("unit_id"), F.lit(1.0).alias("outcome"), F.lit(0.0).alias("agreement")
    )
    return reviewed, scored, adjudicated_set(reviewed, scored, ["unit_id", "grid"], overrides)


@query(
    "N17 B9 B11",
    "WITH "
    + views.DOC_SCORED_SQL
    + _REVIEW_SQL
    + """
SELECT unit_id, CASE WHEN agreement = 1 THEN 'full' ELSE 'some' END || '-' || CASE WHEN outcome = 1 THEN 'case' ELSE 'control' END AS segment,
       CASE WHEN outcome = 1 THEN 'orange' ELSE 'blue' END AS color, p_model, p_majority
FROM final WHERE agreement < 1
""",
)
def disagreement_rows(spark: SparkSession, folder: str) -> DataFrame:
    final = _final_set(spark, folder)[2].where(F.col("agreement") < 1)
    named = final.withColumn("kind", F.when(F.col("outcome") == 1, "case").otherwise("control"))
    return named.select(
        "unit_id",
        disagreement_segment("outcome", "agreement").alias("segment"),
        map_values("kind", {"case": "orange", "control": "blue"}).alias("color"),
        "p_model",
        "p_majority",
    )


@query(
    "N18 C4 B10 B7 D2",
    "WITH "
    + views.DOC_SCORED_SQL
    + _REVIEW_SQL
    + """
SELECT (SELECT count(*) FROM doc_scored) AS n_scored, (SELECT count(*) FROM reviewed) AS n_reviewed,
       (SELECT count(*) FROM doc_scored) - (SELECT count(*) FROM reviewed) AS n_excluded,
       count(*) AS n_kept, count(DISTINCT grid) AS n_owners
FROM final
""",
)
def adjudicated_counts(spark: SparkSession, folder: str) -> DataFrame:
    reviewed, scored, final = _final_set(spark, folder)
    return review_counts(reviewed, scored, final, "unit_id", "grid")


@query(
    "N19 D7 O5",
    "WITH "
    + views.DOC_SCORED_SQL
    + _REVIEW_SQL
    + """
SELECT 'all' AS part, grid, NULL::VARCHAR AS grid_repeated, 1::BIGINT AS n_rows FROM final
UNION ALL SELECT 'case', grid, grid, 1 FROM final WHERE outcome = 1
UNION ALL SELECT 'clash', grid, NULL, count(*) FROM final GROUP BY grid HAVING count(*) > 1 AND max(outcome) = 1
""",
)
def cohort_export_tables(spark: SparkSession, folder: str) -> DataFrame:
    owners, cases, clash = cohort_export(_final_set(spark, folder)[2], "grid", "outcome")
    one = F.lit(1).cast("bigint").alias("n_rows")
    none = F.lit(None).cast("string").alias("grid_repeated")
    return (
        owners.select(F.lit("all").alias("part"), "grid", none, one)
        .unionByName(cases.select(F.lit("case").alias("part"), "grid", "grid_repeated", one))
        .unionByName(clash.select(F.lit("clash").alias("part"), "grid", none, "n_rows"))
    )


@query(
    "N20 E1 T13",
    "WITH "
    + views.EVENT_SCORES_SQL
    + """, r AS (SELECT event_id, round_even(p_value, 2) AS predicted, y AS actual FROM event_scores)
SELECT event_id, predicted, actual,
       row_number() OVER (PARTITION BY predicted ORDER BY actual, md5(concat(event_id, ':123')), event_id) - 1 AS counts
FROM r
""",
)
def dot_plot_rows(spark: SparkSession, folder: str) -> DataFrame:
    return dot_plot_table(views.event_scores(spark, folder), "p_value", "y", "event_id")


@query(
    "E1",
    """
SELECT l_orderkey, o_orderdate_day, row_number() OVER (PARTITION BY o_orderdate_day ORDER BY md5(concat(l_orderkey, ':1')), l_orderkey) - 1 AS idx
FROM (SELECT o_orderkey AS l_orderkey, strftime(o_orderdate, '%Y-%m') AS o_orderdate_day FROM orders)
""",
)
def running_index(spark: SparkSession, folder: str) -> DataFrame:
    rows = scan(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.date_format("o_orderdate", "yyyy-MM").alias("o_orderdate_day")
    )
    ranked = hash_rank(rows, "l_orderkey", 1, within=["o_orderdate_day"], rank="idx")
    return ranked.withColumn("idx", F.col("idx") - 1)


@query(
    "M12 M13",
    """
WITH e AS (SELECT CAST(user_id AS INT) AS fold, ln(value) AS lv, ln(value * 1.3) AS lp FROM events),
c AS (SELECT fold, CASE WHEN exp(lv) >= 50 THEN 1 ELSE 0 END AS y, CASE WHEN exp(lp) >= 50 THEN 1 ELSE 0 END AS p FROM e),
k AS (SELECT fold, count(*) FILTER (p = 1 AND y = 1) AS tp, count(*) FILTER (p = 1 AND y = 0) AS fp,
             count(*) FILTER (p = 0 AND y = 0) AS tn, count(*) FILTER (p = 0 AND y = 1) AS fn, avg((y - p) * (y - p)) AS mse
      FROM c GROUP BY fold),
u AS (SELECT *, tp + fn > 0 AND tn + fp > 0 AND tp + fp > 0 AND tn + fn > 0 AS usable FROM k)
SELECT fold, round(CASE WHEN usable THEN (tp + tn) / (tp + tn + fp + fn) END, 6) AS acc,
       round(CASE WHEN usable THEN 2 * tp / (2 * tp + fp + fn) END, 6) AS f1,
       round(CASE WHEN usable THEN (tp / (tp + fn) + tn / (tn + fp)) / 2 END, 6) AS auc, round(mse, 6) AS mse
FROM u
""",
)
def fold_metrics_table(spark: SparkSession, folder: str) -> DataFrame:
    logs = scan(spark, folder, "events").select(
        F.col("user_id").cast("int").alias("fold"), F.ln("value").alias("lv"), F.ln(F.col("value") * 1.3).alias("lp")
    )
    rows = logs.select("fold", (F.exp("lp") >= 50).cast("int").alias("p"), (F.exp("lv") >= 50).cast("int").alias("y"))
    return _rounded(fold_metrics(rows, ["fold"], "y", "p"), "acc", "f1", "auc", "mse")


@query(
    "M12 B18",
    "WITH "
    + views.DOC_SCORED_SQL
    + """
SELECT unit_id, CASE WHEN exp(ln(p_model)) >= 0.5 THEN 1 ELSE 0 END AS predicted,
       CASE WHEN p_majority >= 0.5 THEN 1 ELSE 0 END AS truth
FROM doc_scored
""",
)
def class_from_log_regression(spark: SparkSession, folder: str) -> DataFrame:
    logs = views.doc_scored(spark, folder).select(
        "unit_id", F.ln("p_model").alias("lp"), F.when(F.col("p_majority") == 0, -50.0).otherwise(F.ln("p_majority")).alias("ly")
    )
    predicted, truth = class_of_regression("lp", "ly", log_scale=True)
    return logs.select("unit_id", predicted.alias("predicted"), truth.alias("truth"))
