"""Labelling views over the test tables, each once as Spark and once as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weaklabel.functions.nulls import nan_to_null
from weaklabel.operators.cohort import collapse, enrich, with_membership
from weaklabel.operators.features import count_patterns
from weaklabel.operators.label_model import LabelModel
from weaklabel.operators.rules import CASE, CONTROL, Rule, RuleSet, at_least, ladder, present
from weaklabel.operators.votes import majority_prob
from weaklabel.sources.tables import COUNT_COLUMNS, scan

import numpy as np


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


# The text patterns counted per document.
PATTERNS = {
    "counts_emph": r"[!?]{2,}",
    "counts_newline": r"\n",
    "counts_license": r"(?i)license|copyright",
    "counts_secret": r"(?i)password|secret|token",
    "counts_phone": r"[0-9]{3}[-. ][0-9]{4}",
}
DOC_COUNTS = list(PATTERNS)
DOC_RULES = ["LF_emph", "LF_short", "LF_newline", "LF_long", "LF_license"]

DOC_FEATURES_SQL = """
doc_features AS (
  SELECT d.doc_id AS unit_id, d.source AS owner_id, d.lang, d.n_chars,
         CAST(len(regexp_extract_all(d.text, '[!?]{2,}')) AS BIGINT) AS counts_emph,
         CAST(len(regexp_extract_all(d.text, '\\n')) AS BIGINT) AS counts_newline,
         CAST(len(regexp_extract_all(d.text, '(?i)license|copyright')) AS BIGINT) AS counts_license,
         CAST(len(regexp_extract_all(d.text, '(?i)password|secret|token')) AS BIGINT) AS counts_secret,
         CAST(len(regexp_extract_all(d.text, '[0-9]{3}[-. ][0-9]{4}')) AS BIGINT) AS counts_phone,
         CASE WHEN l.quality = 0 THEN 'case' WHEN l.quality = 1 THEN 'control' END AS label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""
DOC_VOTES_SQL = (
    DOC_FEATURES_SQL
    + """,
doc_votes AS (
  SELECT unit_id, owner_id, label,
         CASE WHEN label = 'case' THEN 1 WHEN label = 'control' THEN 0 END AS gold,
         CASE WHEN counts_emph > 0 THEN 1 ELSE -1 END AS LF_emph,
         CASE WHEN n_chars < 200 THEN 1 ELSE -1 END AS LF_short,
         CASE WHEN counts_newline > 0 THEN 0 ELSE 1 END AS LF_newline,
         CASE WHEN n_chars >= 2000 THEN 0 ELSE -1 END AS LF_long,
         CASE WHEN counts_license > 0 THEN 0 ELSE -1 END AS LF_license
  FROM doc_features),
doc_tally AS (
  SELECT *,
         (LF_emph = 1)::INT + (LF_short = 1)::INT + (LF_newline = 1)::INT + (LF_long = 1)::INT + (LF_license = 1)::INT AS n_case,
         (LF_emph = 0)::INT + (LF_short = 0)::INT + (LF_newline = 0)::INT + (LF_long = 0)::INT + (LF_license = 0)::INT AS n_control
  FROM doc_votes),
doc_majority AS (
  SELECT *, CASE WHEN n_case > n_control THEN 1.0::DOUBLE WHEN n_case < n_control THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS prob_case
  FROM doc_tally)
"""
)


def doc_features(spark: SparkSession, folder: str, arrow: bool = False) -> DataFrame:
    """``arrow`` counts in Python tasks: worth their start where all texts of a large table are read."""
    docs = scan(spark, folder, "documents")
    gold = scan(spark, folder, "labels").select("doc_id", "quality")
    counts = [F.regexp_count("text", F.lit(p)).cast("long").alias(n) for n, p in PATTERNS.items()]
    label = F.when(F.col("quality") == 0, "case").when(F.col("quality") == 1, "control")
    # counts come before the join, so the text itself is never shuffled
    own = ["doc_id", "source", "lang", "n_chars"]
    counted = count_patterns(docs.select(*own, "text"), "text", PATTERNS) if arrow else docs.select(*own, *counts)
    return counted.join(gold, "doc_id", "left").select(
        F.col("doc_id").alias("unit_id"), F.col("source").alias("owner_id"), "lang", "n_chars", *DOC_COUNTS, label.alias("label")
    )


def doc_rules() -> RuleSet:
    return RuleSet(
        [
            Rule("LF_emph", present("counts_emph", CASE)),
            Rule("LF_short", ladder((F.col("n_chars") < 200, CASE))),
            Rule("LF_newline", present("counts_newline", CONTROL, otherwise=CASE)),
            Rule("LF_long", at_least("n_chars", 2000, CONTROL)),
            Rule("LF_license", present("counts_license", CONTROL)),
        ]
    )


def doc_votes(spark: SparkSession, folder: str) -> DataFrame:
    gold = F.when(F.col("label") == "case", 1).when(F.col("label") == "control", 0).alias("gold")
    return doc_rules().apply(doc_features(spark, folder), ["unit_id", "owner_id", "label", gold])


def as_int(votes: DataFrame, names=DOC_RULES) -> DataFrame:
    """Votes as plain integers, the type SQL literals have."""
    return votes.withColumns({n: F.col(n).cast("int") for n in names})


# A label model with given parameters, P(vote | class) per rule and vote.
PRIOR = (0.85, 0.15)
FIXED_MU = {
    "LF_emph": ((0.02, 0.01), (0.03, 0.40)),
    "LF_short": ((0.02, 0.01), (0.10, 0.30)),
    "LF_newline": ((0.60, 0.45), (0.40, 0.55)),
    "LF_long": ((0.30, 0.20), (0.02, 0.01)),
    "LF_license": ((0.20, 0.05), (0.02, 0.01)),
}


def fixed_model() -> LabelModel:
    return LabelModel(DOC_RULES, PRIOR, np.array([row for rule in DOC_RULES for row in FIXED_MU[rule]]))


def _odds_sql() -> str:
    terms = ["ln(0.15::DOUBLE / 0.85)"]
    for rule in DOC_RULES:
        (c0, c1), (k0, k1) = FIXED_MU[rule][0], FIXED_MU[rule][1]
        terms.append(f"CASE {rule} WHEN 1 THEN ln({k1}::DOUBLE / {k0}) WHEN 0 THEN ln({c1}::DOUBLE / {c0}) ELSE 0.0 END")
    return " + ".join(terms)


DOC_SCORED_SQL = (
    DOC_VOTES_SQL
    + f""",
doc_scored AS (
  SELECT unit_id, owner_id, label, gold, LF_emph, LF_short, LF_newline, LF_long, LF_license,
         prob_case AS p_majority, round(1 / (1 + exp(-({_odds_sql()}))), 6) AS p_model
  FROM doc_majority)
"""
)


def doc_scored(spark: SparkSession, folder: str) -> DataFrame:
    """Votes with the majority and the fixed model's probability."""
    votes = doc_votes(spark, folder)
    return votes.withColumns({"p_majority": majority_prob(DOC_RULES), "p_model": r6(fixed_model().prob_case())})


EVENT_SCORES_SQL = """
event_scores AS (
  SELECT event_id, user_id, event_type, value,
         CASE WHEN event_type IN ('error', 'purchase') THEN 1 ELSE 0 END AS y,
         least(value / 400, 1.0::DOUBLE) AS p_value,
         floor((value / 100 - floor(value / 100)) * 50) / 50 AS p_cents
  FROM events)
"""


def event_scores(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "events").select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        F.when(F.col("event_type").isin("error", "purchase"), 1).otherwise(0).alias("y"),
        F.least(F.col("value") / 400, F.lit(1.0)).alias("p_value"),
        (F.floor((F.col("value") / 100 - F.floor(F.col("value") / 100)) * 50) / 50).alias("p_cents"),
    )


def _order_columns() -> list[Column]:
    return [
        F.col("o_orderkey").alias("unit_id"),
        F.col("o_custkey").alias("owner_id"),
        F.when(F.col("o_totalprice") > 5000, F.col("o_orderdate")).alias("start_ts"),
        F.col("o_totalprice").alias("amount"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "case").otherwise("control").alias("study_group"),
        F.when(F.col("o_orderstatus") == "F", "FEMALE").otherwise("MALE").alias("gender"),
        "o_orderstatus",
    ]


def order_units(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "orders").select(*_order_columns())


ORDER_UNITS_SQL = """
order_units AS (
  SELECT o_orderkey AS unit_id, o_custkey AS owner_id,
         CASE WHEN o_totalprice > 5000 THEN o_orderdate END AS start_ts, o_totalprice AS amount,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'case' ELSE 'control' END AS study_group,
         CASE WHEN o_orderstatus = 'F' THEN 'FEMALE' ELSE 'MALE' END AS gender, o_orderstatus
  FROM orders)
"""

LINE_ORDER = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"]


def line_flags(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("unit_id"),
        *LINE_ORDER,
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("flag_r"),
        F.when(F.col("l_linestatus") == "O", "Yes").otherwise("No").alias("flag_o"),
    )


LINE_LISTS_SQL = """
line_lists AS (
  SELECT l_orderkey AS unit_id,
         string_agg(CASE WHEN l_returnflag = 'R' THEN '1' ELSE '0' END, ';;'
                    ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS flag_r_list,
         string_agg(CASE WHEN l_linestatus = 'O' THEN 'Yes' ELSE 'No' END, ';;'
                    ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS flag_o_list,
         count(*) AS counts_lines
  FROM lineitem GROUP BY l_orderkey)
"""


def line_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Lists per order; a hot order is joined month by month first."""
    return collapse(
        line_flags(spark, folder),
        ["unit_id"],
        {"flag_r": "nan", "flag_o": "nan"},
        LINE_ORDER,
        segment=F.trunc("l_shipdate", "month"),
        extra={"counts_lines": (F.count(F.lit(1)), F.sum)},
    )


VISITS_SQL = (
    ORDER_UNITS_SQL
    + ","
    + LINE_LISTS_SQL
    + """,
visits AS (
  SELECT u.unit_id, u.owner_id, u.start_ts, u.amount, u.study_group, u.gender,
         coalesce(l.flag_r_list, 'nan') AS flag_r_list, coalesce(l.flag_o_list, 'nan') AS flag_o_list,
         l.counts_lines
  FROM order_units u LEFT JOIN line_lists l ON u.unit_id = l.unit_id
  WHERE u.start_ts IS NOT NULL)
"""
)


def visits(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order: events are collapsed first, so the join meets one row per side."""
    units = order_units(spark, folder).dropna(subset=["start_ts"])
    joined = enrich(units, line_lists(spark, folder), on=["unit_id"], check=False)
    lists = {c: F.coalesce(c, F.lit("nan")) for c in ("flag_r_list", "flag_o_list")}
    return joined.withColumns(lists).drop("o_orderstatus")


# A clinical-shaped table from orders and lineitem, so that the shipped rules run on whole tables.
# What counts as a mention, as SQL conditions both engines read the same way.
MENTIONS = {
    "counts_naloxone": "l_discount > 0.085",
    "counts_naloxone_effective": "l_discount > 0.085 AND l_quantity > 35",
    "counts_naloxone_NOT_effective": "l_discount > 0.085 AND l_quantity < 14",
    "counts_resp_care_notes": "l_quantity > 40",
    "counts_rapid_response": "l_quantity > 47",
    "counts_no_acute_events": "l_tax < 0.015",
    "counts_altered_mental_status": "l_extendedprice > 90000",
    "counts_narcotic_overdose": "l_tax > 0.075 AND l_quantity > 45",
    "counts_hypoxia": "l_tax > 0.075 AND l_quantity < 5",
    "counts_decrease_opioids": "l_discount < 0.005 AND l_quantity > 45",
    "counts_no_pain_meds": "l_discount < 0.005 AND l_quantity < 5",
    "counts_held_opioids": "l_discount < 0.015 AND l_tax > 0.065 AND l_quantity > 30",
    "counts_pinpoint_pupils": "l_discount > 0.095 AND l_tax < 0.005",
}
assert list(MENTIONS) == COUNT_COLUMNS
CONFOUNDED = "l_quantity > 48 AND l_linenumber > 4"

CLINICAL_SQL = (
    ORDER_UNITS_SQL
    + ","
    + LINE_LISTS_SQL
    + ",\nmentions AS (SELECT l_orderkey AS unit_id, "
    + ", ".join(f"count(*) FILTER ({cond}) AS {name}" for name, cond in MENTIONS.items())
    + f""" FROM lineitem GROUP BY l_orderkey),
confounded AS (SELECT DISTINCT l_orderkey AS unit_id FROM lineitem WHERE {CONFOUNDED}),
clinical AS (
  SELECT u.unit_id AS visit_occurrence_id, u.owner_id AS person_id, u.study_group, u.gender, u.amount,
         CASE WHEN u.o_orderstatus <> 'P' THEN round(u.amount / 500000, 4) END AS naloxone_admin_prob,
         coalesce(l.flag_r_list, 'nan') AS respiratory_failure_any, coalesce(l.flag_o_list, 'nan') AS eligible_vent,
         """
    + ", ".join(f"m.{name}" for name in MENTIONS)
    + """,
         c.unit_id IS NOT NULL AS has_confounder
  FROM order_units u
  LEFT JOIN line_lists l ON u.unit_id = l.unit_id
  LEFT JOIN mentions m ON u.unit_id = m.unit_id
  LEFT JOIN confounded c ON u.unit_id = c.unit_id)
"""
)


def clinical(spark: SparkSession, folder: str) -> DataFrame:
    # lists and counts come from one grouping, so the lines are shuffled once
    per_visit = collapse(
        line_flags(spark, folder),
        ["unit_id"],
        {"flag_r": "nan", "flag_o": "nan"},
        LINE_ORDER,
        segment=F.trunc("l_shipdate", "month"),
        extra={name: (F.count_if(F.expr(cond)), F.sum) for name, cond in MENTIONS.items()},
    )
    # a partial order has no drug record; it arrives as NaN and leaves as NULL
    prob = F.when(F.col("o_orderstatus") == "P", F.lit(float("nan"))).otherwise(F.round(F.col("amount") / 500000, 4))
    units = nan_to_null(order_units(spark, folder).withColumn("naloxone_admin_prob", prob))
    joined = enrich(units, per_visit, on=["unit_id"], check=False)
    ids = scan(spark, folder, "lineitem", where=F.expr(CONFOUNDED)).select(F.col("l_orderkey").alias("unit_id"))
    flagged = with_membership(joined, ids, "unit_id", "has_confounder")
    return flagged.select(
        F.col("unit_id").alias("visit_occurrence_id"),
        F.col("owner_id").alias("person_id"),
        "study_group",
        "gender",
        "amount",
        "naloxone_admin_prob",
        F.coalesce("flag_r_list", F.lit("nan")).alias("respiratory_failure_any"),
        F.coalesce("flag_o_list", F.lit("nan")).alias("eligible_vent"),
        *COUNT_COLUMNS,
        "has_confounder",
    )
