"""Soft targets and features over the test tables."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from weaklabel.catalog import views
from weaklabel.catalog.registry import query
from weaklabel.catalog.views import r6
from weaklabel.operators.quality import expect_positive
from weaklabel.operators.features import (
    assemble,
    binary_features,
    blended_outcome,
    confidence_weight,
    feature_columns,
    feature_matrix,
    fill_outcome_from_label,
    hard_target,
    log_target,
    probability_limits,
    scaling,
    standardize,
    treatment_flag,
)
from weaklabel.sources.tables import scan

_LIMITS_SQL = """,
limits AS (SELECT 0.95 * min(p_model) AS lo, 0.95 * (1 - max(p_model)) + max(p_model) AS hi FROM doc_scored)
"""


@query(
    "L1",
    "WITH " + views.DOC_SCORED_SQL + _LIMITS_SQL + "SELECT round(lo, 6) AS lower_limit, round(hi, 6) AS upper_limit FROM limits",
)
def target_limits(spark: SparkSession, folder: str) -> DataFrame:
    out = probability_limits(views.doc_scored(spark, folder), "p_model")
    return out.withColumns({"lower_limit": r6("lower_limit"), "upper_limit": r6("upper_limit")})


@query(
    "L2 L3 L4",
    "WITH "
    + views.DOC_SCORED_SQL
    + _LIMITS_SQL
    + """,
o AS (SELECT unit_id, p_model, CASE WHEN label IS NULL THEN p_model WHEN label = 'case' THEN hi ELSE lo END AS outcome
      FROM doc_scored, limits)
SELECT unit_id, round(outcome, 6) AS outcome, CAST(outcome >= 0.5 AS INT) AS y, round(abs(p_model - 0.5), 6) AS weight FROM o
""",
)
def soft_targets(spark: SparkSession, folder: str) -> DataFrame:
    rows = blended_outcome(views.doc_scored(spark, folder), "p_model")
    return rows.select(
        "unit_id",
        r6("outcome").alias("outcome"),
        hard_target("outcome").alias("y"),
        r6(confidence_weight("p_model")).alias("weight"),
    )


@query(
    "L2",
    "WITH "
    + views.DOC_SCORED_SQL
    + _LIMITS_SQL
    + """
SELECT unit_id, round(CASE WHEN p_model < 0.3 THEN p_model WHEN label = 'case' THEN hi ELSE lo END, 6) AS outcome
FROM doc_scored, limits
""",
)
def outcome_from_label(spark: SparkSession, folder: str) -> DataFrame:
    scored = views.doc_scored(spark, folder)
    partial = scored.withColumn("outcome", F.when(F.col("p_model") < 0.3, F.col("p_model")))
    filled = fill_outcome_from_label(partial, probability_limits(scored, "p_model"))
    return filled.select("unit_id", r6("outcome").alias("outcome"))


@query(
    "L5",
    """
SELECT user_id, CASE WHEN contains(string_agg(event_type, ';;'), 'err') OR contains(string_agg(event_type, ';;'), 'purch')
       THEN 1 ELSE 0 END AS binary_naloxone_admin
FROM events WHERE user_id IS NOT NULL GROUP BY user_id
""",
)
def treatment_received(spark: SparkSession, folder: str) -> DataFrame:
    return treatment_flag(scan(spark, folder, "events"), ["user_id"], "event_type", ("err", "purch"))


_CLINICAL_FLAGS = """
CASE WHEN contains(respiratory_failure_any, '1') THEN 1 ELSE 0 END AS binary_respiratory_failure_any,
CASE WHEN contains(eligible_vent, 'Yes') THEN 1 ELSE 0 END AS binary_eligible_vent,
CASE WHEN gender = 'FEMALE' THEN 1 ELSE 0 END AS binary_gender_female,
CASE WHEN has_confounder THEN 1 ELSE 0 END AS binary_cond_sepsis
"""


def _clinical_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.clinical(spark, folder).withColumn("cond_sepsis", F.when(F.col("has_confounder"), 1))
    return binary_features(
        rows,
        {
            "binary_respiratory_failure_any": ("respiratory_failure_any", "1"),
            "binary_eligible_vent": ("eligible_vent", "Yes"),
        },
        {"binary_gender_female": ("gender", "FEMALE"), "binary_cond_sepsis": ("cond_sepsis", 1)},
    )


@query("L6 B13 B14", "WITH " + views.CLINICAL_SQL + "SELECT visit_occurrence_id, " + _CLINICAL_FLAGS + " FROM clinical")
def binary_feature_flags(spark: SparkSession, folder: str) -> DataFrame:
    return _clinical_features(spark, folder).select(
        "visit_occurrence_id",
        "binary_respiratory_failure_any",
        "binary_eligible_vent",
        "binary_gender_female",
        "binary_cond_sepsis",
    )


@query(
    "L7 B4 B12",
    "WITH "
    + views.CLINICAL_SQL
    + ", flagged AS (SELECT *, "
    + _CLINICAL_FLAGS
    + """ FROM clinical)
SELECT visit_occurrence_id, amount, binary_respiratory_failure_any::DOUBLE AS binary_respiratory_failure_any,
       binary_eligible_vent::DOUBLE AS binary_eligible_vent, binary_gender_female::DOUBLE AS binary_gender_female,
       binary_cond_sepsis::DOUBLE AS binary_cond_sepsis, """
    + ", ".join(f"coalesce({c}, 0)::DOUBLE AS {c}" for c in views.MENTIONS)
    + " FROM flagged",
)
def feature_matrix_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = _clinical_features(spark, folder)
    return feature_matrix(rows, feature_columns(rows, first=["amount"]), ["visit_occurrence_id"])


@query(
    "L8",
    "WITH "
    + views.DOC_FEATURES_SQL
    + """,
s AS (SELECT avg(n_chars) AS m1, stddev_pop(n_chars) AS s1, avg(counts_emph) AS m2, stddev_pop(counts_emph) AS s2,
             avg(counts_newline) AS m3, stddev_pop(counts_newline) AS s3 FROM doc_features WHERE label IS NULL)
SELECT unit_id, round((n_chars - m1) / CASE WHEN s1 = 0 THEN 1 ELSE s1 END, 6) AS n_chars,
       round((counts_emph - m2) / CASE WHEN s2 = 0 THEN 1 ELSE s2 END, 6) AS counts_emph,
       round((counts_newline - m3) / CASE WHEN s3 = 0 THEN 1 ELSE s3 END, 6) AS counts_newline
FROM doc_features, s
""",
)
def standardized_features(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["n_chars", "counts_emph", "counts_newline"]
    rows = feature_matrix(views.doc_features(spark, folder), columns, ["unit_id", "label"])
    fitted = scaling(rows.where(F.col("label").isNull()), columns)
    return standardize(rows, columns, fitted).select("unit_id", *[r6(c).alias(c) for c in columns])


@query(
    "L7 L8",
    "WITH "
    + views.DOC_FEATURES_SQL
    + """
SELECT unit_id, n_chars::DOUBLE AS f0, counts_emph::DOUBLE AS f1, counts_phone::DOUBLE AS f2 FROM doc_features
""",
)
def assembled_vectors(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["n_chars", "counts_emph", "counts_phone"]
    rows = assemble(feature_matrix(views.doc_features(spark, folder), columns, ["unit_id"]), columns)
    return rows.select("unit_id", vector_to_array("features").alias("a")).select("unit_id", *[F.col("a")[i].alias(f"f{i}") for i in range(3)])


@query(
    "L9 O4",
    "WITH "
    + views.DOC_SCORED_SQL
    + "SELECT unit_id, round(ln(p_model), 6) AS log_p, round(exp(ln(p_model)), 6) AS p FROM doc_scored",
)
def log_targets(spark: SparkSession, folder: str) -> DataFrame:
    scored = expect_positive(views.doc_scored(spark, folder), "p_model")
    rows = scored.select("unit_id", log_target("p_model").alias("log_p"))
    return rows.select("unit_id", r6("log_p").alias("log_p"), r6(F.exp("log_p")).alias("p"))
