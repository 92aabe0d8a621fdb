"""Joins over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weaklabel.catalog import views
from weaklabel.catalog.registry import query
from weaklabel.operators.cohort import (
    difference,
    enrich,
    exclude_owners,
    outer_join,
    refresh_features,
    semi_join_any,
    with_membership,
)
from weaklabel.operators.quality import expect_unique
from weaklabel.operators.split import holdout
from weaklabel.sources.tables import scan


@query(
    "C1 O1",
    """
SELECT coalesce(e.user_id, c.c_custkey) AS user_id, e.event_id::DOUBLE AS event_id, e.value, c.c_acctbal, c.c_mktsegment
FROM events e FULL OUTER JOIN customer c ON e.user_id = c.c_custkey
""",
)
def outer_join_events(spark: SparkSession, folder: str) -> DataFrame:
    events = scan(spark, folder, "events").select("user_id", F.col("event_id").cast("double").alias("event_id"), "value")
    customer = scan(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), "c_acctbal", "c_mktsegment")
    return outer_join(events, expect_unique(customer, "user_id"), ["user_id"])


@query(
    "C2",
    "WITH "
    + views.CLINICAL_SQL
    + """
SELECT visit_occurrence_id, person_id, naloxone_admin_prob, coalesce(counts_naloxone, -9) AS counts_naloxone,
       CAST(has_confounder AS INT) AS has_confounder
FROM clinical
""",
)
def enrich_chain(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.clinical(spark, folder)
    return rows.select(
        "visit_occurrence_id",
        "person_id",
        "naloxone_admin_prob",
        F.coalesce("counts_naloxone", F.lit(-9).cast("bigint")).alias("counts_naloxone"),
        F.col("has_confounder").cast("int").alias("has_confounder"),
    )


@query(
    "C3",
    """
SELECT d.doc_id, d.source, l.quality::DOUBLE AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""",
)
def attach_labels(spark: SparkSession, folder: str) -> DataFrame:
    gold = scan(spark, folder, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"))
    return enrich(scan(spark, folder, "documents").select("doc_id", "source"), gold, on=["doc_id"])


@query(
    "C4",
    """
SELECT a.doc_id, a.source, a.n_chars, b.outcome, b.n_chars::DOUBLE AS n_chars_scored FROM
  (SELECT doc_id, source, n_chars FROM documents) a
LEFT JOIN (SELECT d.doc_id, d.source, d.n_chars * 2 AS n_chars, l.quality::DOUBLE AS outcome
           FROM documents d JOIN labels l ON d.doc_id = l.doc_id) b
ON a.doc_id = b.doc_id AND a.source = b.source
""",
)
def composite_left_join(spark: SparkSession, folder: str) -> DataFrame:
    docs = scan(spark, folder, "documents").select("doc_id", "source", "n_chars")
    gold = scan(spark, folder, "labels").select("doc_id", F.col("quality").cast("double").alias("outcome"))
    other = docs.join(gold, "doc_id").select("doc_id", "source", "outcome", (F.col("n_chars") * 2).cast("double").alias("n_chars_scored"))
    return enrich(docs, other, on=["doc_id", "source"])


_HALVES_SQL = (
    "WITH "
    + views.CLINICAL_SQL
    + """,
a AS (SELECT visit_occurrence_id AS k1, person_id AS k2, study_group AS k3, gender AS k4, naloxone_admin_prob AS k5,
             amount AS left_amount FROM clinical WHERE amount < 260000),
b AS (SELECT visit_occurrence_id AS k1, person_id AS k2, study_group AS k3, gender AS k4, naloxone_admin_prob AS k5,
             eligible_vent AS right_vent FROM clinical WHERE amount > 240000)
SELECT coalesce(a.k1, b.k1) AS k1, coalesce(a.k2, b.k2) AS k2, coalesce(a.k3, b.k3) AS k3, coalesce(a.k4, b.k4) AS k4,
       coalesce(a.k5, b.k5) AS k5, left_amount, right_vent
FROM a FULL OUTER JOIN b ON a.k1 IS NOT DISTINCT FROM b.k1 AND a.k2 IS NOT DISTINCT FROM b.k2
  AND a.k3 IS NOT DISTINCT FROM b.k3 AND a.k4 IS NOT DISTINCT FROM b.k4 AND a.k5 IS NOT DISTINCT FROM b.k5
"""
)


@query("C5", _HALVES_SQL)
def outer_join_null_safe(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["k1", "k2", "k3", "k4", "k5"]
    names = ["visit_occurrence_id", "person_id", "study_group", "gender", "naloxone_admin_prob"]
    rows = views.clinical(spark, folder).withColumnsRenamed(dict(zip(names, keys, strict=True)))
    left = rows.where(F.col("amount") < 260000).select(*keys, F.col("amount").alias("left_amount"))
    right = rows.where(F.col("amount") > 240000).select(*keys, F.col("eligible_vent").alias("right_vent"))
    return outer_join(left, right, keys, null_safe=True, write_first=True)


@query(
    "C6",
    """
SELECT doc_id, source FROM documents
WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) OR doc_id IN (SELECT item_id FROM benchmark)
""",
)
def semi_join_either(spark: SparkSession, folder: str) -> DataFrame:
    toxic = scan(spark, folder, "labels").where(F.col("toxic") == 1).select("doc_id")
    items = scan(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"))
    return semi_join_any(scan(spark, folder, "documents").select("doc_id", "source"), "doc_id", toxic, items)


@query("C7", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_ids(spark: SparkSession, folder: str) -> DataFrame:
    return difference(scan(spark, folder, "documents").select("doc_id", "source"), scan(spark, folder, "labels"), "doc_id")


@query(
    "C8",
    """
WITH test AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 400000)
SELECT o_orderkey, o_custkey, CASE WHEN o_custkey IN (SELECT o_custkey FROM test) THEN 'removed' ELSE 'kept' END AS state
FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM test)
""",
)
def owner_exclusion(spark: SparkSession, folder: str) -> DataFrame:
    orders = scan(spark, folder, "orders").select("o_orderkey", "o_custkey")
    test = scan(spark, folder, "orders", where=(F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 400000))
    rest = difference(orders, test, "o_orderkey")
    kept, removed = exclude_owners(rest, test, "o_custkey")
    columns = ["o_orderkey", "o_custkey"]
    return kept.select(*columns, F.lit("kept").alias("state")).unionByName(
        removed.select(*columns, F.lit("removed").alias("state"))
    )


@query(
    "C9",
    """
SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48) THEN 1 ELSE 0 END AS listed
FROM orders
""",
)
def existence_flag(spark: SparkSession, folder: str) -> DataFrame:
    ids = scan(spark, folder, "lineitem", where=F.col("l_quantity") > 48).select(F.col("l_orderkey").alias("o_orderkey"))
    flagged = with_membership(scan(spark, folder, "orders").select("o_orderkey"), ids, "o_orderkey", "listed")
    return flagged.withColumn("listed", F.col("listed").cast("int"))


@query(
    "C10",
    "WITH "
    + views.DOC_FEATURES_SQL
    + """
SELECT f.unit_id, f.owner_id, f.n_chars, f.counts_emph + 1 AS counts_emph, f.counts_phone AS counts_phone,
       CASE WHEN l.toxic = 1 THEN 1 ELSE 0 END AS cond_toxic
FROM doc_features f LEFT JOIN labels l ON f.unit_id = l.doc_id
""",
)
def refresh_feature_families(spark: SparkSession, folder: str) -> DataFrame:
    features = views.doc_features(spark, folder)
    stale = features.withColumn("cond_old", F.lit(7)).drop("lang", "label")
    counts = features.select("unit_id", (F.col("counts_emph") + 1).alias("counts_emph"), "counts_phone")
    conditions = scan(spark, folder, "labels").select(F.col("doc_id").alias("unit_id"), F.col("toxic").alias("cond_toxic"))
    fresh = refresh_features(stale, {"counts_": counts, "cond_": conditions}, on=["unit_id"], check=False)
    return fresh.withColumn("cond_toxic", F.when(F.col("cond_toxic") == 1, 1).otherwise(0))


@query(
    "H1 C6 C7",
    """
SELECT doc_id, CASE WHEN doc_id IN (SELECT item_id FROM benchmark)
                     OR doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 'test' ELSE 'train' END AS split
FROM documents
""",
)
def holdout_by_lists(spark: SparkSession, folder: str) -> DataFrame:
    cases = scan(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"))
    controls = scan(spark, folder, "labels").where(F.col("quality") == 0).select("doc_id")
    flagged = holdout(scan(spark, folder, "documents").select("doc_id"), "doc_id", cases, controls)
    return flagged.select("doc_id", F.when(F.col("is_test"), "test").otherwise("train").alias("split"))
