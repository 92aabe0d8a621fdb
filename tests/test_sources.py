import pytest
from pyspark.sql import functions as F

from weaklabel.operators.features import assemble
from weaklabel.sources import tables as T


def test_csv_missing_text_and_nan(spark, tmp_path):
    folder = tmp_path / "d"
    folder.mkdir()
    (folder / "a.csv").write_text("visit_occurrence_id\ttf_model_prob\n1\t0.5\n2\t\n3\tNaN\n")
    rows = T.read_delimited(spark, str(folder), T.DRUG_PROBABILITY, sep="\t").collect()
    assert {tuple(r) for r in rows} == {(1, 0.5), (2, None), (3, None)}


def test_header_case_and_dates(spark, tmp_path):
    upper = [f.name.upper() for f in T.DEMOGRAPHICS.fields]
    (tmp_path / "p.tsv").write_text(
        "\t".join(upper) + "\n7\t2020-01-02 03:04:05\t2020-01-03 00:00:00\t1970-05-06 00:00:00\t49.5\tFEMALE\n"
    )
    df = T.read_delimited(spark, str(tmp_path / "p.tsv"), T.DEMOGRAPHICS, sep="\t", file_columns=upper)
    assert df.columns == [f.name for f in T.DEMOGRAPHICS.fields]
    assert df.select(F.date_format("visit_start_datetime", "yyyy-MM-dd HH:mm:ss")).first()[0] == "2020-01-02 03:04:05"


def test_other_columns_are_refused(spark, tmp_path):
    (tmp_path / "x.csv").write_text("person_id\n1\n")
    with pytest.raises(Exception, match="(?i)header|schema"):
        T.read_delimited(spark, str(tmp_path / "x.csv"), T.ID_LIST).collect()


def test_text_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", now'), (2, None)], "visit_occurrence_id long, note string")
    path = T.write_delimited(df, str(tmp_path / "out"))
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([StructField("visit_occurrence_id", LongType()), StructField("note", StringType())])
    assert {tuple(r) for r in T.read_delimited(spark, path, schema).collect()} == {(1, 'say "hi", now'), (2, None)}


def test_round_store_prunes_and_replaces(spark, tmp_path):
    store = T.RoundStore(spark, str(tmp_path / "rounds"))
    frame = spark.createDataFrame([(1, "train"), (2, "dev")], "id long, split string")
    store.write(frame, 1)
    store.write(frame.where("id = 1"), 2)
    store.write(frame, 1)
    assert store.load(1).count() == 2 and store.load(2).count() == 1
    plan = store.load(1, "dev")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(round" in plan
    assert store.splits(1)["dev"].first()["id"] == 2


def test_bundle(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="f")]).fit(df)
    path = T.save_bundle(str(tmp_path / "b"), {"rows": df}, {"m": model})
    back = T.load_model(path, "m").transform(T.load_table(spark, path, "rows")).first()
    assert list(back["f"]) == [1.0, 2.0] and list(assemble(df, ["a", "b"]).first()["features"]) == [1.0, 2.0]


def test_a_rerun_replaces_a_whole_round(spark, tmp_path):
    store = T.RoundStore(spark, str(tmp_path / "rounds"))
    rows = spark.createDataFrame([(1, "train"), (2, "excluded")], "id int, split string")
    store.write(rows, 1)
    store.write(rows, 2)
    store.write(rows.where("split = 'train'"), 1)
    assert sorted((r["id"], r["round"]) for r in spark.read.parquet(store.path).collect()) == [(1, 1), (1, 2), (2, 2)]


def test_only_a_missing_result_table_is_empty(spark, tmp_path):
    assert T.ResultStore(spark, str(tmp_path / "none")).load().count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        T.ResultStore(spark, str(tmp_path / "bad")).load().collect()


def test_repeated_and_half_written_results_are_read_once(spark, tmp_path):
    store = T.ResultStore(spark, str(tmp_path / "cv"))
    rows = spark.createDataFrame([("m", "p", f, "f1", 0.5) for f in (1, 2)], "model string, params string, fold int, metric string, value double")
    store.append(rows.where("fold = 1"))
    store.append(rows.where("fold = 1"))
    store.append(rows.where("fold = 2"), part="second")
    assert sorted(r["fold"] for r in store.load().collect()) == [1, 2]
    # rows without their commit, as a writer that died leaves them
    lost = rows.where("fold = 2").selectExpr("model", "'q' AS params", "fold", "metric", "value", "cast(null as string) AS run", "'lost' AS attempt", "'rows' AS kind")
    lost.write.mode("append").partitionBy("kind", "attempt").parquet(str(tmp_path / "cv"))
    assert store.load().where("params = 'q'").count() == 0
    assert [r["params"] for r in store.pending(lost.select("model", "params")).collect()] == ["q"]


def test_a_round_is_read_from_its_own_folder(spark, tmp_path):
    store = T.RoundStore(spark, str(tmp_path / "rounds"))
    frame = spark.range(6).select("id", F.when(F.col("id") < 4, "train").otherwise("dev").alias("split"))
    store.write(frame, 1)
    store.write(frame.withColumn("more", F.lit(1)), 2)
    assert "more" not in store.load(1).columns
    assert {f.rsplit("/rounds/")[1].split("/")[0] for f in store.load(2).inputFiles()} == {"round=2"}
    assert store.load(2, "dev").count() == 2 and store.load(2).first()["round"] == 2
