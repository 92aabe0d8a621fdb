"""One small set of rows per missing-value trap."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weaklabel.functions.nulls import as_text, contains_flag, encode_label, equals_flag, nan_to_null
from weaklabel.functions.rounding import round_half_even
from weaklabel.operators.cohort import collapse, outer_join
from weaklabel.operators.features import blended_outcome, log_target, scaling
from weaklabel.operators.quality import ExpectationFailed, expect_positive

NAN = float("nan")


def values(df, column):
    return [r[column] for r in df.collect()]


def test_nan_becomes_null_and_comparisons_are_false(spark):
    df = spark.createDataFrame([(1, NAN), (2, None), (3, 0.9)], "id int, p double")
    assert df.where("p >= 0.8").count() == 2, "Spark sorts NaN above every number"
    clean = nan_to_null(df)
    assert clean.where("p >= 0.8").count() == 1
    assert clean.where("p IS NULL").count() == 2


def test_equal_to_zero_is_not_taken_for_missing_counts(spark):
    df = spark.createDataFrame([(None,), (0,), (1,)], "c long")
    assert values(df.select(F.when(F.col("c") == 0, 0).otherwise(-1).alias("v")), "v") == [-1, 0, -1]


def test_sum_with_a_missing_part_is_missing(spark):
    df = spark.createDataFrame([(1, None), (0, 0), (1, 1)], "a long, b long")
    assert values(df.select(F.when(F.col("a") + F.col("b") > 0, -1).otherwise(0).alias("v")), "v") == [0, 0, -1]


def test_text_form_keeps_missing_entries(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, None), (1, 3, 0.0)], "k int, o int, v double")
    assert collapse(df, ["k"], {"v": "nan"}, ["o"]).first()["v_list"] == "1.0;;nan;;0.0"
    assert values(df.select(as_text("v", "NaT").alias("t")), "t") == ["1.0", "NaT", "0.0"]


def test_float_text_does_not_match_a_run_of_ones(spark):
    df = spark.createDataFrame([("1;;1;;1;;1",), ("1.0;;1.0;;1.0;;1.0",)], "v string")
    assert values(df.select(F.col("v").contains("1;;1;;1;;1").alias("hit")), "hit") == [True, False]


def test_flag_of_missing_text_follows_null_flag(spark):
    df = spark.createDataFrame([("Yes",), ("yes",), (None,)], "v string")
    assert values(df.select(contains_flag("v", "Yes").alias("f")), "f") == [1, 0, 1]
    assert values(df.select(contains_flag("v", "Yes", null_flag=0).alias("f")), "f") == [1, 0, 0]


def test_equality_flag_and_label_of_missing_are_zero(spark):
    df = spark.createDataFrame([("case", 1), ("control", 0), (None, None)], "label string, c int")
    assert values(df.select(encode_label().alias("y")), "y") == [1, 0, 0]
    assert values(df.select(equals_flag("c", 1).alias("f")), "f") == [1, 0, 0]


def test_missing_group_keys_are_dropped(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    assert values(collapse(df, ["k"], {"v": "nan"}, ["v"]), "k") == [1]


def test_missing_keys_match_each_other_when_asked(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, 5, "y")], "i int, j int, l string")
    b = spark.createDataFrame([(1, None, "p"), (3, None, "q")], "i int, j int, r string")
    rows = {tuple(r) for r in outer_join(a, b, ["i", "j"], null_safe=True).collect()}
    assert rows == {(1, None, "x", "p"), (2, 5, "y", None), (3, None, None, "q")}
    plain = {tuple(r) for r in outer_join(a, b, ["i", "j"]).collect()}
    assert plain == {(1, None, "x", None), (2, 5, "y", None), (1, None, None, "p"), (3, None, None, "q")}


def test_label_missing_means_model_probability_in_outcome(spark):
    df = spark.createDataFrame([(1, None, 0.4), (2, "case", 0.2), (3, "control", 0.6)], "id int, label string, p double")
    out = {r["id"]: r["outcome"] for r in blended_outcome(df, "p").collect()}
    assert out[1] == 0.4
    assert out[2] == pytest.approx(0.95 * (1 - 0.6) + 0.6)
    assert out[3] == pytest.approx(0.95 * 0.2)


def test_text_outcome_needs_try_cast(spark):
    df = spark.createDataFrame([("1.0",), ("",), ("unclear",)], "o string")
    assert values(df.select(F.col("o").try_cast("double").alias("d")), "d") == [1.0, None, None]


def test_half_even_rounding_matches_numpy(spark):
    xs = [0.125, 0.375, 1.275, 2.675, 0.5, 0.005, 0.015, 0.995, 0.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [r["r"] for r in df.select(round_half_even("x", 2).alias("r")).collect()] == np.round(xs, 2).tolist()


def test_log_needs_positive_values(spark):
    df = spark.createDataFrame([(1.0,), (0.0,)], "p double")
    assert values(df.select(log_target("p").alias("l")), "l") == [0.0, None]
    with pytest.raises(ExpectationFailed):
        expect_positive(df, "p")
    assert expect_positive(df.where("p > 0"), "p").count() == 1


def test_scaling_uses_population_deviation_and_keeps_constants(spark):
    df = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (4.0, 7.0)], "a double, b double")
    fitted = scaling(df, ["a", "b"]).first()
    assert fitted["a"]["sd"] == pytest.approx(math.sqrt(14 / 9))
    assert fitted["b"]["sd"] == 1.0
