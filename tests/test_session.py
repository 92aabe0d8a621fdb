from pyspark.sql import functions as F

from weaklabel import session


def test_written_tables_are_read_back_and_forgotten(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "run_folder", lambda _: str(tmp_path / "run"))
    df = spark.range(5).withColumn("x", F.rand(1))
    kept = session.written(df, "five")
    assert kept.dtypes == df.dtypes and kept.collect() == kept.collect() and kept.count() == 5
    assert session.written(df, "five").inputFiles() != kept.inputFiles(), "every write has a path of its own"
    assert session.forget(spark) and not (tmp_path / "run").exists()
    assert session.forget(spark) is False


def test_an_application_writes_in_a_folder_of_its_own(spark):
    path = session.shared_path(spark, "x")
    assert path.startswith(session.shared_folder(spark)) and spark.sparkContext.applicationId in path
