"""Sources and sinks over the test tables."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

from weaklabel.catalog import views
from weaklabel.catalog.registry import query
from weaklabel.catalog.views import r6
from weaklabel.operators.cohort import enrich
from weaklabel.operators.split import stratified_split
from weaklabel.session import shared_path
from weaklabel.sources.tables import (
    ResultStore,
    RoundStore,
    load_model,
    load_table,
    lower_columns,
    read_delimited,
    save_bundle,
    scan,
    write_delimited,
)


def _schema(**kinds) -> StructType:
    return StructType([StructField(n, k, True) for n, k in kinds.items()])


@query(
    "A1 A4 A6",
    """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority
FROM orders
""",
)
def scan_tab_delimited(spark: SparkSession, folder: str) -> DataFrame:
    orders = scan(spark, folder, "orders")
    upper = orders.toDF(*[c.upper() for c in orders.columns])
    path = write_delimited(upper, shared_path(spark, "orders-tsv"), sep="\t")
    schema = _schema(
        o_orderkey=LongType(),
        o_custkey=LongType(),
        o_orderstatus=StringType(),
        o_totalprice=DoubleType(),
        o_orderdate=TimestampType(),
        o_orderpriority=StringType(),
    )
    back = read_delimited(spark, path, schema, sep="\t", file_columns=upper.columns)
    return back.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query(
    "A2 A6",
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate
FROM lineitem
""",
)
def scan_pipe_delimited(spark: SparkSession, folder: str) -> DataFrame:
    lines = scan(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate")
    path = write_delimited(lines, shared_path(spark, "lines-psv"), sep="|")
    schema = _schema(
        l_orderkey=LongType(),
        l_linenumber=IntegerType(),
        l_partkey=LongType(),
        l_quantity=DoubleType(),
        l_shipdate=TimestampType(),
    )
    back = read_delimited(spark, path, schema, sep="|")
    return back.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))


@query("A3 A6", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def scan_comma_text(spark: SparkSession, folder: str) -> DataFrame:
    docs = scan(spark, folder, "documents")
    # whole texts with line breaks and quotes survive when every field is quoted
    path = shared_path(spark, "docs-csv")
    docs.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    schema = _schema(doc_id=LongType(), text=StringType(), lang=StringType(), source=StringType(), n_chars=LongType())
    # leading and trailing blanks are part of a text
    return read_delimited(
        spark,
        path,
        schema,
        multiLine=True,
        lineSep="\n",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
        maxCharsPerColumn=-1,
    )


@query("A4", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def lowercase_columns(spark: SparkSession, folder: str) -> DataFrame:
    customer = scan(spark, folder, "customer")
    return lower_columns(customer.toDF(*[c.upper() for c in customer.columns]))


_ROUND_SQL = (
    "WITH "
    + views.ORDER_UNITS_SQL
    + """, ranked AS (
  SELECT unit_id, study_group,
         row_number() OVER (PARTITION BY study_group ORDER BY md5(concat(unit_id, ':123')), unit_id) AS r
  FROM order_units),
named AS (
  SELECT study_group, CASE
    WHEN r <= CASE study_group WHEN 'case' THEN 33 ELSE 17 END THEN 'dev'
    WHEN r <= 2 * CASE study_group WHEN 'case' THEN 33 ELSE 17 END THEN 'valid' ELSE 'train' END AS split
  FROM ranked)
SELECT 2 AS round, split, study_group, count(*) AS n_units FROM named GROUP BY split, study_group
"""
)


@query("A5", _ROUND_SQL)
def round_loader(spark: SparkSession, folder: str) -> DataFrame:
    units = views.order_units(spark, folder).select("unit_id", "owner_id", "study_group")
    store = RoundStore(spark, shared_path(spark, "rounds"))
    named = stratified_split(units, "unit_id", "study_group", {"case": 33, "control": 17})
    store.write(named, 2)
    store.write(named.where(F.col("split") != "train"), 3)
    return store.load(2).groupBy("round", "split", "study_group").agg(F.count(F.lit(1)).alias("n_units"))


@query(
    "A6",
    "SELECT event_id, user_id, event_type, value, props FROM events",
)
def csv_sink(spark: SparkSession, folder: str) -> DataFrame:
    events = scan(spark, folder, "events").select("event_id", "user_id", "event_type", "value", "props")
    path = write_delimited(events, shared_path(spark, "events-csv"))
    schema = _schema(event_id=LongType(), user_id=LongType(), event_type=StringType(), value=DoubleType(), props=StringType())
    return read_delimited(spark, path, schema)


@query(
    "A7",
    "WITH "
    + views.DOC_VOTES_SQL
    + """
SELECT 'votes' AS name, count(*) AS n_rows, CAST(sum(LF_emph + LF_newline) AS BIGINT) AS checksum FROM doc_votes
UNION ALL SELECT 'features', count(*), CAST(sum(counts_emph + counts_newline) AS BIGINT) FROM doc_features
UNION ALL SELECT 'model', count(*), CAST(sum(n_chars + counts_emph) AS BIGINT) FROM doc_features
""",
)
def artifact_bundle(spark: SparkSession, folder: str) -> DataFrame:
    features, votes = views.doc_features(spark, folder), views.doc_votes(spark, folder)
    assembler = VectorAssembler(inputCols=["n_chars", "counts_emph"], outputCol="features")
    model = Pipeline(stages=[assembler]).fit(features)
    path = save_bundle(shared_path(spark, "bundle"), {"votes": votes, "features": features}, {"prepare": model})

    def total(name: str, df: DataFrame, value) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(value).cast("long").alias("checksum")).select(
            F.lit(name).alias("name"), "*"
        )

    from pyspark.ml.functions import vector_to_array

    saved = load_table(spark, path, "features")
    arrays = load_model(path, "prepare").transform(saved).withColumn("a", vector_to_array("features"))
    return (
        total("votes", load_table(spark, path, "votes"), F.col("LF_emph").cast("int") + F.col("LF_newline"))
        .unionByName(total("features", saved, F.col("counts_emph") + F.col("counts_newline")))
        .unionByName(total("model", arrays, F.col("a")[0] + F.col("a")[1]))
    )


@query(
    "A8",
    """
SELECT DISTINCT event_type AS model, CAST(user_id AS VARCHAR) AS params FROM events
WHERE event_type NOT IN ('click', 'view')
""",
)
def resumable_results(spark: SparkSession, folder: str) -> DataFrame:
    events = scan(spark, folder, "events").select(
        F.col("event_type").alias("model"),
        F.col("user_id").cast("string").alias("params"),
        F.lit(1).alias("fold"),
        F.lit("f1").alias("metric"),
        "value",
    )
    store = ResultStore(spark, shared_path(spark, "results"))
    for done in ("click", "view"):
        store.append(events.where(F.col("model") == done))
    return store.pending(events.select("model", "params").distinct())


@query(
    "A9",
    "WITH "
    + views.DOC_SCORED_SQL
    + """
SELECT s.unit_id, s.p_majority, s.p_model, round(s.n / 20000.0::DOUBLE, 6) AS sens_length_prob
FROM (SELECT d.*, f.n_chars AS n FROM doc_scored d JOIN doc_features f ON d.unit_id = f.unit_id) s
""",
)
def wide_scored_table(spark: SparkSession, folder: str) -> DataFrame:
    scored = views.doc_scored(spark, folder)
    other = views.doc_features(spark, folder).select("unit_id", r6(F.col("n_chars") / 20000.0).alias("sens_length_prob"))
    return enrich(scored.select("unit_id", "p_majority", "p_model"), other, on=["unit_id"], check=False)


