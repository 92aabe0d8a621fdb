"""Readers, writers, the round store, artifact bundles and the resumable result store."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

from weaklabel.functions.nulls import nan_to_null


def _schema(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields])


# The input columns the clinical tables come with.
COUNT_COLUMNS = [
    "counts_naloxone",
    "counts_naloxone_effective",
    "counts_naloxone_NOT_effective",
    "counts_resp_care_notes",
    "counts_rapid_response",
    "counts_no_acute_events",
    "counts_altered_mental_status",
    "counts_narcotic_overdose",
    "counts_hypoxia",
    "counts_decrease_opioids",
    "counts_no_pain_meds",
    "counts_held_opioids",
    "counts_pinpoint_pupils",
]
CONDITION_COLUMNS = ["cond_resp_failure", "cond_sepsis", "cond_cva", "cond_resp_disease", "cond_cv_disease"]

DEMOGRAPHICS = _schema(
    ("visit_occurrence_id", LongType()),
    ("visit_start_datetime", TimestampType()),
    ("visit_end_datetime", TimestampType()),
    ("birth_datetime", TimestampType()),
    ("age_on_admission", DoubleType()),
    ("gender", StringType()),
)
EVENT_ROWS = _schema(
    ("visit_occurrence_id", LongType()),
    ("person_id", LongType()),
    ("grid", StringType()),
    ("study_group", StringType()),
    ("respiratory_failure_any", StringType()),
    ("eligible_vent", StringType()),
    ("numerator_condition_start_date", TimestampType()),
    ("numerator_procedure_date", TimestampType()),
    ("proc_earliest", TimestampType()),
    ("procedure_date", TimestampType()),
)
DRUG_PROBABILITY = _schema(("visit_occurrence_id", LongType()), ("tf_model_prob", DoubleType()))
REGEX_COUNTS = _schema(("visit_occurrence_id", LongType()), *[(c, LongType()) for c in COUNT_COLUMNS])
CONFOUNDERS = _schema(("visit_occurrence_id", LongType()), *[(c, IntegerType()) for c in CONDITION_COLUMNS])
DRUG_ROWS = _schema(
    ("visit_occurrence_id", LongType()),
    ("grid", StringType()),
    ("label", StringType()),
    ("x_frequency", StringType()),
    ("drug_source_value", StringType()),
    ("x_doc_type", StringType()),
    ("x_doc_stype", StringType()),
)
ID_LIST = _schema(("visit_occurrence_id", LongType()))
ADJUDICATED = _schema(
    ("visit_occurrence_id", LongType()),
    ("grid", StringType()),
    ("outcome", DoubleType()),
    ("agreement", DoubleType()),
)


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def read_delimited(
    spark: SparkSession, path: str, schema: StructType, sep: str = ",", file_columns: Iterable[str] | None = None, **options
) -> DataFrame:
    """Read a headed text table whose files hold exactly ``schema``'s columns, in file order.

    The schema is given, so there is no inference pass, and ``enforceSchema`` is off so
    that a file with other columns fails instead of being read shifted. ``file_columns``
    gives the header names when their case differs from the schema's.
    """
    names = list(file_columns) if file_columns else [f.name for f in schema.fields]
    as_in_file = StructType([StructField(n, f.dataType, True) for n, f in zip(names, schema.fields, strict=True)])
    reader = spark.read.schema(as_in_file).option("header", True).option("sep", sep).option("enforceSchema", False)
    # whole fields: a quoted text may hold newlines and doubled quotes
    reader = reader.option("multiLine", options.pop("multiLine", False)).option("escape", '"').options(**options)
    return nan_to_null(lower_columns(reader.csv(path)) if file_columns else reader.csv(path))


def write_delimited(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> str:
    """Write a headed text table, one file per partition, no row index."""
    df.write.mode(mode).option("header", True).option("sep", sep).option("escape", '"').csv(path)
    return path


def scan(spark: SparkSession, folder: str, table: str, where: Column | None = None) -> DataFrame:
    """A parquet table with NaN already turned into NULL.

    ``where`` (comparisons joined by and/or) is applied to the raw columns, so that it is
    pushed into the scan, and again after NaN became NULL: NaN passes some raw comparisons
    that NULL does not.
    """
    raw = spark.read.parquet(f"{folder}/{table}.parquet")
    return nan_to_null(raw) if where is None else nan_to_null(raw.where(where)).where(where)


class RoundStore:
    """All rounds and splits in one table partitioned by both, so a round is a pruned read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, frame: DataFrame, round: int) -> None:
        """Write one labelled frame (with a ``split`` column) as a round; a rerun replaces it as a whole."""
        frame.write.mode("overwrite").partitionBy("split").parquet(f"{self.path}/round={round}")

    def load(self, round: int, split: str | None = None) -> DataFrame:
        """One round, or one split of it: only that folder is listed and read."""
        folder = f"{self.path}/round={round}"
        rows = self.spark.read.option("basePath", self.path).parquet(folder).where(F.col("round") == round)
        return rows.where(F.col("split") == split) if split else rows

    def splits(self, round: int) -> dict[str, DataFrame]:
        rows = self.load(round)
        return {s: rows.where(F.col("split") == s) for s in ("train", "dev", "valid", "test")}


def save_bundle(path: str, tables: Mapping[str, DataFrame], models: Mapping[str, PipelineModel] | None = None) -> str:
    """Write named tables and fitted models under one folder."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/tables/{name}")
    for name, model in (models or {}).items():
        model.write().overwrite().save(f"{path}/models/{name}")
    return path


def load_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/tables/{name}")


def load_model(path: str, name: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/models/{name}")


class ResultStore:
    """Cross-validation results in long form: finished work is skipped after a restart.

    One table, partitioned by kind and by the number of an append, so that appends at one time don't meet. Once all rows
    of an append are written, a commit row names the part of the work that they are. Only committed numbers are read, and
    of a part that was appended more than once only the first by number: neither a half-written nor a repeated append shows.
    """

    schema = "model string, params string, fold int, metric string, value double, run string"
    _stored = f"{schema}, part string, kind string, attempt string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, kind: str) -> DataFrame:
        try:
            return self.spark.read.schema(self._stored).parquet(self.path).where(F.col("kind") == kind)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self._stored)

    def load(self) -> DataFrame:
        chosen = self._read("commit").groupBy("part").agg(F.min("attempt").alias("attempt")).select("attempt")
        return self._read("rows").join(chosen, "attempt", "left_semi").drop("attempt", "part", "kind")

    def append(self, rows: DataFrame, part: str | None = None) -> None:
        """Add finished work; ``run`` names the settings it belongs to and may be left out.

        ``part`` names the piece of work; without it the models, params, folds and runs of the rows name it.
        """
        if "run" not in rows.columns:
            rows = rows.withColumn("run", F.lit(None).cast("string"))
        attempt = uuid.uuid4().hex
        rows.select(*[f.split()[0] for f in self.schema.split(", ")]).write.parquet(f"{self.path}/kind=rows/attempt={attempt}")
        if part is None:
            mine = self._read("rows").where(F.col("attempt") == attempt)
            keys = mine.select(F.xxhash64("model", "params", "fold", "run").cast("decimal(38,0)").alias("h")).distinct()
            part = str(keys.agg(F.struct(F.count("h"), F.sum("h"))).first()[0])
        commit = self.spark.createDataFrame([(part,)], "part string")
        commit.coalesce(1).write.parquet(f"{self.path}/kind=commit/attempt={attempt}")

    def pending(self, wanted: DataFrame, keys: Iterable[str] = ("model", "params")) -> DataFrame:
        keys = list(keys)
        return wanted.join(self.load().select(*keys).distinct(), keys, "left_anti")
