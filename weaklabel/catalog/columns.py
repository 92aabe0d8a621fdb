"""Projections, filters, conditional columns and sorts over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weaklabel.catalog import views
from weaklabel.catalog.registry import query
from weaklabel.catalog.views import as_int, r6
from weaklabel.functions.nulls import as_text, contains_flag, encode_label, equals_flag
from weaklabel.functions.rounding import round_half_even
from weaklabel.operators.cohort import (
    difference,
    drop_matching,
    map_values,
    melt,
    override_cells,
    rows_at_max,
    select_matching,
    semi_join_any,
    top_k,
    union_by_name,
)
from weaklabel.operators.evaluate import two_score_prediction
from weaklabel.operators.rules import rows_with_vote
from weaklabel.sources.tables import scan


@query("B1", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def select_columns(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")


@query("B2", "SELECT event_id AS unit_id, value AS naloxone_admin_prob FROM events")
def rename_columns(spark: SparkSession, folder: str) -> DataFrame:
    events = scan(spark, folder, "events").select("event_id", "value")
    return events.withColumnsRenamed({"event_id": "unit_id", "value": "naloxone_admin_prob"})


@query("B3", "WITH " + views.DOC_FEATURES_SQL + "SELECT unit_id, owner_id, lang, n_chars, label FROM doc_features")
def drop_column_family(spark: SparkSession, folder: str) -> DataFrame:
    return drop_matching(views.doc_features(spark, folder), "counts_")


@query(
    "B4",
    "WITH "
    + views.DOC_FEATURES_SQL
    + "SELECT n_chars, counts_emph, counts_newline, counts_license, counts_secret, counts_phone FROM doc_features",
)
def select_column_family(spark: SparkSession, folder: str) -> DataFrame:
    features = views.doc_features(spark, folder)
    return features.select(*select_matching(features, "counts_", first=["n_chars"]))


@query("B5", "SELECT * EXCLUDE (l_tax, l_discount, l_shipdate) FROM lineitem")
def drop_columns(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "lineitem").drop("l_tax", "l_discount", "l_shipdate")


@query(
    "B6",
    "WITH "
    + views.DOC_SCORED_SQL
    + "SELECT unit_id, label, p_model FROM doc_scored WHERE label = 'case' AND p_model <= 0.5",
)
def filter_compare(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.doc_scored(spark, folder)
    return rows.where((F.col("label") == "case") & (F.col("p_model") <= 0.5)).select("unit_id", "label", "p_model")


@query(
    "B7",
    "WITH "
    + views.CLINICAL_SQL
    + """
SELECT visit_occurrence_id, 'no record' AS state FROM clinical WHERE naloxone_admin_prob IS NULL
UNION ALL SELECT visit_occurrence_id, 'record' FROM clinical WHERE NOT (naloxone_admin_prob IS NULL)
""",
)
def filter_missing(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.clinical(spark, folder).select("visit_occurrence_id", "naloxone_admin_prob")
    missing = F.col("naloxone_admin_prob").isNull()
    none = rows.where(missing).select("visit_occurrence_id", F.lit("no record").alias("state"))
    return none.unionByName(rows.where(~missing).select("visit_occurrence_id", F.lit("record").alias("state")))


@query(
    "B8", "WITH " + views.EVENT_SCORES_SQL + "SELECT event_id, p_cents FROM event_scores WHERE p_cents > 0.01"
)
def filter_positive(spark: SparkSession, folder: str) -> DataFrame:
    return views.event_scores(spark, folder).where(F.col("p_cents") > 0.01).select("event_id", "p_cents")


@query(
    "B9",
    "WITH "
    + views.DOC_SCORED_SQL
    + """
SELECT unit_id, CASE WHEN label IS NULL THEN p_model ELSE CASE WHEN label = 'case' THEN 0.99 ELSE 0.01 END END AS outcome,
       CASE WHEN p_model >= 0.5 THEN 1 ELSE 0 END AS hard
FROM doc_scored
""",
)
def conditional_column(spark: SparkSession, folder: str) -> DataFrame:
    outcome = F.when(F.col("label").isNull(), F.col("p_model")).when(F.col("label") == "case", 0.99).otherwise(0.01)
    return views.doc_scored(spark, folder).select(
        "unit_id", outcome.alias("outcome"), F.when(F.col("p_model") >= 0.5, 1).otherwise(0).alias("hard")
    )


@query(
    "B10",
    """
SELECT d.doc_id, CASE WHEN b.item_id IS NOT NULL THEN 1.0::DOUBLE WHEN l.quality IS NOT NULL THEN (1 - l.quality)::DOUBLE END AS outcome,
       CASE WHEN b.item_id IS NOT NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS agreement
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN benchmark b ON d.doc_id = b.item_id
""",
)
def override_named_cells(spark: SparkSession, folder: str) -> DataFrame:
    docs = scan(spark, folder, "documents").select("doc_id")
    gold = scan(spark, folder, "labels").select("doc_id", (1 - F.col("quality")).cast("double").alias("outcome"))
    reviewed = docs.join(gold, "doc_id", "left").withColumn("agreement", F.lit(1.0))
    # the overrides are a table: ids of the benchmark stand for re-reviewed rows
    overrides = scan(spark, folder, "benchmark").select(
        F.col("item_id").alias("doc_id"), F.lit(1.0).alias("outcome"), F.lit(0.0).alias("agreement")
    )
    return override_cells(reviewed, overrides, "doc_id")


@query(
    "B11",
    """
SELECT event_id, CASE event_type WHEN 'error' THEN 'red' WHEN 'purchase' THEN 'orange' WHEN 'view' THEN 'blue' END AS color
FROM events
""",
)
def map_category(spark: SparkSession, folder: str) -> DataFrame:
    colors = {"error": "red", "purchase": "orange", "view": "blue"}
    return scan(spark, folder, "events").select("event_id", map_values("event_type", colors).alias("color"))


@query(
    "B12",
    "WITH "
    + views.CLINICAL_SQL
    + """
SELECT visit_occurrence_id, coalesce(counts_naloxone, 0) AS counts_naloxone, coalesce(counts_hypoxia, 0) AS counts_hypoxia,
       coalesce(naloxone_admin_prob, 0) AS naloxone_admin_prob
FROM clinical
""",
)
def fill_missing(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.clinical(spark, folder).select("visit_occurrence_id", "counts_naloxone", "counts_hypoxia", "naloxone_admin_prob")
    return rows.fillna({"counts_naloxone": 0, "counts_hypoxia": 0, "naloxone_admin_prob": 0.0})


@query(
    "B13",
    "WITH "
    + views.ORDER_UNITS_SQL
    + ","
    + views.LINE_LISTS_SQL
    + """
SELECT u.unit_id, CASE WHEN l.flag_o_list IS NULL THEN 1 WHEN contains(l.flag_o_list, 'Yes') THEN 1 ELSE 0 END AS binary_vent,
       CASE WHEN contains(l.flag_r_list, '1') THEN 1 ELSE 0 END AS binary_failure_strict
FROM order_units u LEFT JOIN line_lists l ON u.unit_id = l.unit_id
""",
)
def text_contains_flag(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.order_units(spark, folder).join(views.line_lists(spark, folder), "unit_id", "left")
    return rows.select(
        "unit_id",
        contains_flag("flag_o_list", "Yes").alias("binary_vent"),
        contains_flag("flag_r_list", "1", null_flag=0).alias("binary_failure_strict"),
    )


@query(
    "B14",
    "WITH "
    + views.VISITS_SQL
    + """
SELECT unit_id, CASE WHEN gender = 'FEMALE' THEN 1 ELSE 0 END AS binary_gender_female,
       CASE WHEN counts_lines = 1 THEN 1 ELSE 0 END AS binary_single
FROM visits
""",
)
def equality_flag(spark: SparkSession, folder: str) -> DataFrame:
    return views.visits(spark, folder).select(
        "unit_id",
        equals_flag("gender", "FEMALE").alias("binary_gender_female"),
        equals_flag("counts_lines", 1).alias("binary_single"),
    )


@query(
    "B15",
    "WITH " + views.DOC_FEATURES_SQL + "SELECT unit_id, CASE WHEN label = 'case' THEN 1 ELSE 0 END AS y FROM doc_features",
)
def label_encode(spark: SparkSession, folder: str) -> DataFrame:
    return views.doc_features(spark, folder).select("unit_id", encode_label().alias("y"))


@query(
    "B16",
    "WITH "
    + views.DOC_VOTES_SQL
    + """
SELECT unit_id, LF_emph, LF_short, LF_newline FROM doc_votes WHERE LF_emph = -1 AND LF_newline = 1
""",
)
def rows_by_vote(spark: SparkSession, folder: str) -> DataFrame:
    votes = rows_with_vote(views.doc_votes(spark, folder), LF_emph=-1, LF_newline=1)
    return as_int(votes).select("unit_id", "LF_emph", "LF_short", "LF_newline")


@query("B17 F1", "SELECT event_id, user_id, value FROM events ORDER BY user_id, event_id LIMIT 10")
def first_rows(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "events").select("event_id", "user_id", "value").orderBy("user_id", "event_id").limit(10)


@query(
    "B18",
    "WITH "
    + views.EVENT_SCORES_SQL
    + """
SELECT event_id, CASE WHEN p_value >= 0.5 THEN 1 ELSE 0 END AS pred_50, CASE WHEN p_value >= 0.1 THEN 1 ELSE 0 END AS pred_10
FROM event_scores
""",
)
def threshold_prediction(spark: SparkSession, folder: str) -> DataFrame:
    return views.event_scores(spark, folder).select(
        "event_id",
        (F.col("p_value") >= 0.5).cast("int").alias("pred_50"),
        (F.col("p_value") >= 0.1).cast("int").alias("pred_10"),
    )


@query(
    "B19",
    "WITH "
    + views.DOC_SCORED_SQL
    + "SELECT unit_id, CASE WHEN p_majority >= 0.7 AND p_model >= 0.3 THEN 1 ELSE 0 END AS predicted FROM doc_scored",
)
def two_score_rule(spark: SparkSession, folder: str) -> DataFrame:
    rule = two_score_prediction({"p_majority": 0.7, "p_model": 0.3})
    return views.doc_scored(spark, folder).select("unit_id", rule.alias("predicted"))


@query(
    "B20 C6 F1",
    "WITH "
    + views.DOC_SCORED_SQL
    + """
SELECT unit_id, p_majority, p_model FROM doc_scored
WHERE abs(p_majority - p_model) > 0.2 AND unit_id IN (SELECT doc_id FROM labels)
ORDER BY p_model
""",
)
def score_discrepancy(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.doc_scored(spark, folder).select("unit_id", "p_majority", "p_model")
    apart = rows.where(F.abs(F.col("p_majority") - F.col("p_model")) > 0.2)
    reviewed = scan(spark, folder, "labels").select(F.col("doc_id").alias("unit_id"))
    return semi_join_any(apart, "unit_id", reviewed).orderBy("p_model", "unit_id")


@query("F1", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_orderkey, l_linenumber")
def sort_by_keys(spark: SparkSession, folder: str) -> DataFrame:
    lines = scan(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return lines.orderBy("l_orderkey", "l_linenumber")


@query("F2", "SELECT event_id, value FROM events ORDER BY value DESC, event_id")
def sort_descending(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "events").select("event_id", "value").orderBy(F.col("value").desc(), "event_id")


@query("F3", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 20")
def top_scores(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(scan(spark, folder, "events").select("event_id", "value"), "value", "event_id", 20)


@query(
    "F5", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity = (SELECT max(l_quantity) FROM lineitem)"
)
def rows_at_maximum(spark: SparkSession, folder: str) -> DataFrame:
    return rows_at_max(scan(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity")


@query(
    "G1",
    "WITH "
    + views.ORDER_UNITS_SQL
    + """
SELECT unit_id, study_group FROM order_units WHERE study_group = 'case' AND amount > 200000
UNION ALL SELECT unit_id, study_group FROM order_units WHERE study_group = 'control' AND amount > 400000
""",
)
def union_same_columns(spark: SparkSession, folder: str) -> DataFrame:
    units = views.order_units(spark, folder)
    cases = units.where((F.col("study_group") == "case") & (F.col("amount") > 200000)).select("unit_id", "study_group")
    controls = units.where((F.col("study_group") == "control") & (F.col("amount") > 400000)).select("study_group", "unit_id")
    return union_by_name(cases, controls)


@query(
    "G2",
    """
SELECT NULL::VARCHAR AS event_type, doc_id AS unit_id, n_chars::DOUBLE AS n_chars, NULL::DOUBLE AS value FROM documents
UNION ALL SELECT event_type, event_id, NULL, value FROM events
""",
)
def union_missing_columns(spark: SparkSession, folder: str) -> DataFrame:
    docs = scan(spark, folder, "documents").select(F.col("doc_id").alias("unit_id"), F.col("n_chars").cast("double"))
    events = scan(spark, folder, "events").select(F.col("event_id").alias("unit_id"), "event_type", "value")
    return union_by_name(docs, events, sort_columns=True)


@query(
    "G3",
    """
SELECT event_id, value FROM events WHERE event_id NOT IN
  (SELECT event_id FROM events ORDER BY value DESC, event_id LIMIT 20)
""",
)
def difference_by_key(spark: SparkSession, folder: str) -> DataFrame:
    events = scan(spark, folder, "events").select("event_id", "value")
    return difference(events, top_k(events, "value", "event_id", 20), "event_id")


@query(
    "G4",
    "WITH "
    + views.DOC_FEATURES_SQL
    + """
SELECT unit_id, learning_function, learned_weight FROM (
  SELECT unit_id, counts_emph::DOUBLE AS counts_emph, counts_newline::DOUBLE AS counts_newline,
         counts_license::DOUBLE AS counts_license, counts_secret::DOUBLE AS counts_secret, counts_phone::DOUBLE AS counts_phone
  FROM doc_features)
UNPIVOT (learned_weight FOR learning_function IN (counts_emph, counts_newline, counts_license, counts_secret, counts_phone))
""",
)
def melt_wide(spark: SparkSession, folder: str) -> DataFrame:
    return melt(views.doc_features(spark, folder), ["unit_id"], views.DOC_COUNTS, "learning_function", "learned_weight")


@query(
    "2.7",
    """
SELECT event_id, lower(upper(event_type)) AS kind, CAST(contains(lower(event_type), 'view') AS INT) AS has_view,
       CAST(regexp_matches(props, '"k": [0-9]{2}') AS INT) AS two_digits, coalesce(CAST(user_id AS VARCHAR), 'nan') AS user_text,
       round(ln(value), 6) AS log_value, round(exp(-value / 100), 6) AS decay, round(abs(value - 50), 6) AS gap,
       round_even(value / 10, 2) AS rounded, strftime(ts, '%Y-%m-%d') AS day,
       CASE WHEN value > 300 THEN 1 ELSE 0 END AS large
FROM events
""",
)
def scalar_functions(spark: SparkSession, folder: str) -> DataFrame:
    value = F.col("value")
    return scan(spark, folder, "events").select(
        "event_id",
        F.lower(F.upper("event_type")).alias("kind"),
        F.lower("event_type").contains("view").cast("int").alias("has_view"),
        F.col("props").rlike('"k": [0-9]{2}').cast("int").alias("two_digits"),
        as_text("user_id").alias("user_text"),
        r6(F.ln(value)).alias("log_value"),
        r6(F.exp(-value / 100)).alias("decay"),
        r6(F.abs(value - 50)).alias("gap"),
        round_half_even(value / 10, 2).alias("rounded"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.when(value > 300, 1).otherwise(0).alias("large"),
    )


