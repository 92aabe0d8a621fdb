"""Collapse, counts, summaries and checks over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weaklabel.catalog import views
from weaklabel.catalog.registry import query
from weaklabel.catalog.views import r6
from weaklabel.operators.cohort import longest_runs
from weaklabel.operators.evaluate import box_summary, fold_summary, group_outcome_counts, histogram
from weaklabel.operators.quality import duplicate_keys, expect_rows, null_audit, overlap
from weaklabel.sources.tables import scan


@query(
    "D1 C1",
    "WITH "
    + views.VISITS_SQL
    + """
SELECT unit_id, owner_id, strftime(start_ts, '%Y-%m-%d') AS start_day, amount, study_group, flag_r_list, flag_o_list,
       coalesce(counts_lines, 0) AS counts_lines
FROM visits
""",
)
def collapse_visits(spark: SparkSession, folder: str) -> DataFrame:
    return views.visits(spark, folder).select(
        "unit_id",
        "owner_id",
        F.date_format("start_ts", "yyyy-MM-dd").alias("start_day"),
        "amount",
        "study_group",
        "flag_r_list",
        "flag_o_list",
        F.coalesce("counts_lines", F.lit(0)).alias("counts_lines"),
    )


@query(
    "D1 2.7",
    """
WITH marked AS (
  SELECT l_orderkey AS unit_id, l_returnflag = 'R' AS r, l_linestatus = 'O' AS o,
         row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS pos
  FROM lineitem),
runs AS (
  SELECT unit_id, r, o,
         pos - row_number() OVER (PARTITION BY unit_id, r ORDER BY pos) AS gr,
         pos - row_number() OVER (PARTITION BY unit_id, o ORDER BY pos) AS go
  FROM marked),
best_r AS (SELECT unit_id, max(n) AS n FROM (SELECT unit_id, gr, count(*) AS n FROM runs WHERE r GROUP BY unit_id, gr) GROUP BY unit_id),
best_o AS (SELECT unit_id, max(n) AS n FROM (SELECT unit_id, go, count(*) AS n FROM runs WHERE o GROUP BY unit_id, go) GROUP BY unit_id)
SELECT u.unit_id, coalesce(best_r.n, 0) AS run_r, coalesce(best_o.n, 0) AS run_o
FROM (SELECT DISTINCT unit_id FROM marked) u
LEFT JOIN best_r ON u.unit_id = best_r.unit_id LEFT JOIN best_o ON u.unit_id = best_o.unit_id
""",
)
def longest_matching_runs(spark: SparkSession, folder: str) -> DataFrame:
    return longest_runs(
        views.line_flags(spark, folder),
        ["unit_id"],
        {"run_r": F.col("flag_r") == 1, "run_o": F.col("flag_o") == "Yes"},
        [*views.LINE_ORDER, "flag_r", "flag_o"],
        segment=F.trunc("l_shipdate", "month"),
    )


@query(
    "D2",
    "SELECT count(DISTINCT o_custkey) AS n_owners, count(DISTINCT o_orderkey) AS n_units, count(*) AS n_rows FROM orders",
)
def distinct_owners(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "orders").agg(
        F.countDistinct("o_custkey").alias("n_owners"),
        F.countDistinct("o_orderkey").alias("n_units"),
        F.count(F.lit(1)).alias("n_rows"),
    )


@query("D2", "SELECT DISTINCT user_id, event_type FROM events")
def distinct_values(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "events").select("user_id", "event_type").distinct()


@query(
    "D3",
    "WITH "
    + views.DOC_SCORED_SQL
    + """
SELECT count(*) FILTER (p_model >= 0.5 AND gold = 0) AS n_false_positive, count(*) FILTER (gold = 1) AS n_case,
       count(*) FILTER (p_majority = 0 AND gold = 1) AS n_zero_case, count(*) AS n_rows
FROM doc_scored
""",
)
def conditional_counts(spark: SparkSession, folder: str) -> DataFrame:
    gold = F.col("gold")
    return views.doc_scored(spark, folder).agg(
        F.count_if((F.col("p_model") >= 0.5) & (gold == 0)).alias("n_false_positive"),
        F.count_if(gold == 1).alias("n_case"),
        F.count_if((F.col("p_majority") == 0) & (gold == 1)).alias("n_zero_case"),
        F.count(F.lit(1)).alias("n_rows"),
    )


@query(
    "D4",
    """
SELECT min(l_extendedprice) AS low, max(l_extendedprice) AS high, round(avg(l_discount), 6) AS mean,
       CAST(sum(l_quantity) AS BIGINT) AS total
FROM lineitem
""",
)
def scalar_summary(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "lineitem").agg(
        F.min("l_extendedprice").alias("low"),
        F.max("l_extendedprice").alias("high"),
        r6(F.avg("l_discount")).alias("mean"),
        F.sum("l_quantity").cast("bigint").alias("total"),
    )


@query(
    "D5 M14",
    """
SELECT event_type AS model, 'value' AS metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd,
       count(value) AS n_folds, count(*) FILTER (value IS NULL) AS n_skipped
FROM (SELECT event_type, CASE WHEN value < 200 THEN value END AS value FROM events) GROUP BY event_type
""",
)
def fold_summary_table(spark: SparkSession, folder: str) -> DataFrame:
    events = scan(spark, folder, "events").select(
        F.col("event_type").alias("model"), F.lit("value").alias("metric"), F.when(F.col("value") < 200, F.col("value")).alias("value")
    )
    return fold_summary(events).withColumns({"mean": r6("mean"), "sd": r6("sd")})


@query(
    "D6",
    "WITH "
    + views.VISITS_SQL
    + """
SELECT CASE WHEN amount > 250000 THEN 1 ELSE 0 END AS outcome, count(*) FILTER (study_group = 'case') AS n_case,
       count(*) FILTER (study_group = 'control') AS n_control
FROM visits GROUP BY 1
""",
)
def group_outcome_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.visits(spark, folder).withColumn("outcome", F.when(F.col("amount") > 250000, 1).otherwise(0))
    return group_outcome_counts(rows, "study_group", "outcome", ["case", "control"])


@query(
    "D7",
    "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
)
def duplicate_key_rows(spark: SparkSession, folder: str) -> DataFrame:
    return duplicate_keys(scan(spark, folder, "lineitem"), "l_orderkey", "l_linenumber")


_HIST_SQL = """
WITH v AS (SELECT event_type, {value} AS v FROM events),
e AS (SELECT event_type, min(v) AS lo, max(v) AS hi FROM v GROUP BY event_type),
b AS (SELECT v.event_type, CAST(least(floor((v - lo) / (hi - lo) * {bins}), {bins} - 1) AS INT) AS bin, count(*) AS n
      FROM v JOIN e ON v.event_type = e.event_type GROUP BY 1, 2)
SELECT e.event_type, CAST(g.bin AS INT) AS bin, round(lo + g.bin * (hi - lo) / {bins}, 6) AS bin_start, coalesce(b.n, 0) AS n_rows
FROM e CROSS JOIN (SELECT unnest(range({bins})) AS bin) g
LEFT JOIN b ON b.event_type = e.event_type AND b.bin = g.bin
"""


@query("D8", _HIST_SQL.format(value="value", bins=25))
def histogram_values(spark: SparkSession, folder: str) -> DataFrame:
    events = scan(spark, folder, "events").select("event_type", "value")
    return histogram(events, "value", 25, ["event_type"]).withColumn("bin_start", r6("bin_start"))


@query(
    "D8 L9",
    """
WITH v AS (SELECT round(ln(l_extendedprice), 6) AS v FROM lineitem),
e AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
b AS (SELECT CAST(least(floor((v - lo) / (hi - lo) * 100), 99) AS INT) AS bin, count(*) AS n FROM v, e GROUP BY 1)
SELECT CAST(g.bin AS INT) AS bin, round(lo + g.bin * (hi - lo) / 100, 9) AS bin_start, coalesce(b.n, 0) AS n_rows
FROM e CROSS JOIN (SELECT unnest(range(100)) AS bin) g LEFT JOIN b ON b.bin = g.bin
""",
)
def histogram_log(spark: SparkSession, folder: str) -> DataFrame:
    logs = scan(spark, folder, "lineitem").select(r6(F.ln("l_extendedprice")).alias("v"))
    # the logs have 6 digits and there are 100 bins, so 9 digits never sit on a rounding edge
    return histogram(logs, "v", 100).withColumn("bin_start", F.round("bin_start", 9))


@query(
    "D9",
    """
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                  quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type)
SELECT e.event_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, count(*) AS n_rows,
       min(value) FILTER (value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)) AS whisker_low,
       max(value) FILTER (value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
       count(*) FILTER (NOT (value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1))) AS n_outliers
FROM events e JOIN q ON e.event_type = q.event_type GROUP BY e.event_type, q1, median, q3
""",
)
def box_summary_table(spark: SparkSession, folder: str) -> DataFrame:
    out = box_summary(scan(spark, folder, "events").select("event_type", "value"), "value", ["event_type"])
    return out.withColumns({c: r6(c) for c in ("q1", "median", "q3")})


@query(
    "O6",
    "WITH "
    + views.CLINICAL_SQL
    + """
SELECT 'naloxone_admin_prob' AS column_name, count(*) FILTER (naloxone_admin_prob IS NULL) AS n_missing FROM clinical
UNION ALL SELECT 'counts_naloxone', count(*) FILTER (counts_naloxone IS NULL) FROM clinical
UNION ALL SELECT 'counts_hypoxia', count(*) FILTER (counts_hypoxia IS NULL) FROM clinical
UNION ALL SELECT 'eligible_vent', count(*) FILTER (eligible_vent IS NULL) FROM clinical
""",
)
def missing_value_audit(spark: SparkSession, folder: str) -> DataFrame:
    return null_audit(
        views.clinical(spark, folder).select("naloxone_admin_prob", "counts_naloxone", "counts_hypoxia", "eligible_vent")
    )


@query(
    "O1 O2 O3 O4 O5",
    """
SELECT 'rows' AS expectation, (SELECT count(*) FROM documents) AS found
UNION ALL SELECT 'columns', 5
UNION ALL SELECT 'shared keys', (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
UNION ALL SELECT 'not positive', (SELECT count(*) FROM events WHERE value <= 0 OR value IS NULL)
UNION ALL SELECT 'repeated keys', (SELECT count(*) FROM (SELECT user_id FROM events GROUP BY user_id HAVING count(*) > 1))
""",
)
def expectation_report(spark: SparkSession, folder: str) -> DataFrame:
    docs, events, labels = (scan(spark, folder, t) for t in ("documents", "events", "labels"))
    # the guard itself: parts of a table must add up to it
    long, short = docs.where(F.col("n_chars") > 1000), docs.where(~F.coalesce(F.col("n_chars") > 1000, F.lit(False)))
    expect_rows(docs, [long, short])

    def row(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("found")).select(F.lit(name).alias("expectation"), "found")

    columns = docs.agg(F.lit(len(docs.columns)).cast("bigint").alias("found")).select(F.lit("columns").alias("expectation"), "found")
    return (
        row("rows", docs)
        .unionByName(columns)
        .unionByName(row("shared keys", overlap(docs, labels, "doc_id")))
        .unionByName(row("not positive", events.where((F.col("value") <= 0) | F.col("value").isNull())))
        .unionByName(row("repeated keys", duplicate_keys(events, "user_id")))
    )
