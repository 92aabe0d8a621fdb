"""Splits over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weaklabel.catalog import views
from weaklabel.catalog.registry import query
from weaklabel.operators.split import kfold, make_splits, promote, sample_fraction, stratified_split
from weaklabel.sources.tables import scan


@query(
    "H2",
    "WITH "
    + views.ORDER_UNITS_SQL
    + """, ranked AS (
  SELECT unit_id, study_group,
         row_number() OVER (PARTITION BY study_group ORDER BY md5(concat(unit_id, ':123')), unit_id) AS r,
         CASE study_group WHEN 'case' THEN 33 ELSE 17 END AS n
  FROM order_units)
SELECT unit_id, study_group, CASE WHEN r <= n THEN 'dev' WHEN r <= 2 * n THEN 'valid' ELSE 'train' END AS split FROM ranked
""",
)
def stratified_fixed_split(spark: SparkSession, folder: str) -> DataFrame:
    units = views.order_units(spark, folder).select("unit_id", "study_group")
    return stratified_split(units, "unit_id", "study_group", {"case": 33, "control": 17})


@query(
    "H3",
    """
SELECT event_id, event_type FROM (
  SELECT event_id, event_type, row_number() OVER (ORDER BY md5(concat(event_id, ':123')), event_id) AS r,
         count(*) OVER () AS n FROM events)
WHERE r <= round_even(n * 0.5, 0)
""",
)
def fraction_sample(spark: SparkSession, folder: str) -> DataFrame:
    return sample_fraction(scan(spark, folder, "events").select("event_id", "event_type"), "event_id", 0.5)


@query(
    "H4",
    """
SELECT doc_id, CAST(ntile(10) OVER (ORDER BY md5(concat(doc_id, ':987')), doc_id) AS INT) AS fold FROM documents
""",
)
def kfold_assignment(spark: SparkSession, folder: str) -> DataFrame:
    return kfold(scan(spark, folder, "documents").select("doc_id"), "doc_id", 10)


_PROMOTE_SQL = (
    "WITH "
    + views.DOC_SCORED_SQL
    + """,
base AS (
  SELECT unit_id, p_model, CASE WHEN gold = 1 THEN 'dev' WHEN gold = 0 THEN 'valid' ELSE 'train' END AS split FROM doc_scored),
top AS (
  SELECT unit_id FROM base WHERE split = 'train' ORDER BY p_model DESC, unit_id LIMIT 20),
moved AS (
  SELECT unit_id, row_number() OVER (ORDER BY md5(concat(unit_id, ':123')), unit_id) AS r, count(*) OVER () AS n FROM top)
SELECT b.unit_id, b.p_model,
       CASE WHEN m.unit_id IS NULL THEN b.split WHEN m.r <= round_even(m.n * 0.5, 0) THEN 'dev' ELSE 'valid' END AS split
FROM base b LEFT JOIN moved m ON b.unit_id = m.unit_id
"""
)


@query("H5 F3 H3 G2 G3", _PROMOTE_SQL)
def promote_top_scores(spark: SparkSession, folder: str) -> DataFrame:
    scored = views.doc_scored(spark, folder)
    split = F.when(F.col("gold") == 1, "dev").when(F.col("gold") == 0, "valid").otherwise("train")
    return promote(scored.select("unit_id", "p_model", split.alias("split")), "unit_id", "p_model")


_SPLIT_SQL = (
    "WITH "
    + views.ORDER_UNITS_SQL
    + """,
test AS (SELECT unit_id, owner_id FROM order_units
         WHERE unit_id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49 AND l_tax > 0.075)
            OR unit_id IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 499000)),
ranked AS (
  SELECT unit_id, row_number() OVER (PARTITION BY study_group ORDER BY md5(concat(unit_id, ':123')), unit_id) AS r,
         CASE study_group WHEN 'case' THEN 33 ELSE 17 END AS n
  FROM order_units WHERE unit_id NOT IN (SELECT unit_id FROM test))
SELECT u.unit_id, u.owner_id, u.study_group, CASE
  WHEN r.unit_id IS NULL THEN 'test' WHEN r.r <= r.n THEN 'dev' WHEN r.r <= 2 * r.n THEN 'valid'
  WHEN u.owner_id IN (SELECT owner_id FROM test) THEN 'excluded' ELSE 'train' END AS split
FROM order_units u LEFT JOIN ranked r ON u.unit_id = r.unit_id
"""
)


@query("H6 H1 H2 C8", _SPLIT_SQL)
def full_split(spark: SparkSession, folder: str) -> DataFrame:
    lines = scan(spark, folder, "lineitem", where=(F.col("l_quantity") > 49) & (F.col("l_tax") > 0.075))
    cases = lines.select(F.col("l_orderkey").alias("unit_id"))
    units = views.order_units(spark, folder)
    controls = units.where(F.col("amount") > 499000).select("unit_id")
    return make_splits(units.select("unit_id", "owner_id", "study_group"), "unit_id", "owner_id", "study_group", [cases, controls])
