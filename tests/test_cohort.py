import random

import pytest
from pyspark.sql import functions as F

from weaklabel.operators import cohort, quality
from weaklabel.operators.quality import ExpectationFailed


def test_segmented_collapse_equals_plain_collapse(spark):
    rng = random.Random(0)
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.randint(0, 99), i, rng.choice(["Yes", "No", None])) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, day int, seq int, v string")
    plain = {r["k"]: r["v_list"] for r in cohort.collapse(df, ["k"], {"v": "nan"}, ["day", "seq"]).collect()}
    cut = cohort.collapse(df.repartition(5), ["k"], {"v": "nan"}, ["day", "seq"], segment=F.floor(F.col("day") / 10), hot_rows=50)
    assert {r["k"]: r["v_list"] for r in cut.collect()} == plain
    for k in plain:
        mine = sorted([r for r in rows if r[0] == k], key=lambda r: (r[1], r[2]))
        assert plain[k] == ";;".join(r[3] or "nan" for r in mine)


def test_longest_runs_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 2]), i, rng.random() < 0.7) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, day int, hit boolean")
    runs = cohort.longest_runs(df, ["k"], {"run": F.col("hit")}, ["day"], segment=F.floor(F.col("day") / 7), hot_rows=150)
    for r in runs.collect():
        best = now = 0
        for _, _, hit in sorted(x for x in rows if x[0] == r["k"]):
            now = now + 1 if hit else 0
            best = max(best, now)
        assert r["run"] == best


def test_outer_join_keeps_both_sides_and_many_rows(spark):
    events = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c")], "id int, e string")
    people = spark.createDataFrame([(1, 50.0), (2, 60.0)], "id int, age double")
    rows = {tuple(r) for r in cohort.outer_join(events, people, ["id"]).collect()}
    assert rows == {(1, "a", 50.0), (1, "b", 50.0), (3, "c", None), (2, None, 60.0)}


def test_enrich_refuses_a_table_with_repeated_keys(spark):
    df = spark.createDataFrame([(1,)], "id int")
    with pytest.raises(ExpectationFailed):
        cohort.enrich(df, spark.createDataFrame([(1, 2), (1, 3)], "id int, x int"), on=["id"])


def test_refresh_leaves_the_callers_frame_alone(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "id int, counts_a int, cond_b int, keep int")
    fresh = cohort.refresh_features(
        df,
        {"counts_": spark.createDataFrame([(1, 9)], "id int, counts_z int"), "cond_": spark.createDataFrame([], "id int, cond_y int")},
        on=["id"],
    )
    assert fresh.first().asDict() == {"id": 1, "keep": 4, "counts_z": 9, "cond_y": None}
    assert df.columns == ["id", "counts_a", "cond_b", "keep"]


def test_overrides_membership_and_mapping(spark):
    df = spark.createDataFrame([(1, 0.0), (2, None)], "id int, outcome double")
    new = cohort.override_cells(df, spark.createDataFrame([(2, 1.0)], "id int, outcome double"), "id")
    assert {tuple(r) for r in new.collect()} == {(1, 0.0), (2, 1.0)}
    ids = spark.createDataFrame([(1,), (1,), (None,)], "id int")
    flagged = cohort.with_membership(df, ids, "id", "known")
    assert {(r["id"], r["known"]) for r in flagged.collect()} == {(1, True), (2, False)}
    mapped = spark.createDataFrame([("a",), ("z",)], "v string").select(cohort.map_values("v", {"a": "red"}).alias("c"))
    assert [r["c"] for r in mapped.collect()] == ["red", None]


def test_union_difference_melt_top_and_max(spark):
    a = spark.createDataFrame([(1, 5.0)], "id int, b double")
    b = spark.createDataFrame([("x", 2)], "a string, id int")
    both = cohort.union_by_name(a, b, sort_columns=True)
    assert both.columns == ["a", "b", "id"] and both.count() == 2
    assert cohort.difference(a, b, "id").count() == 1
    wide = spark.createDataFrame([(1, 0.5, 0.7)], "seed int, LF_a double, accuracy double")
    long = cohort.melt(wide, ["seed"], None, "rule", "weight")
    assert {(r["rule"], r["weight"]) for r in long.collect()} == {("LF_a", 0.5), ("accuracy", 0.7)}
    s = spark.createDataFrame([(3, 1.0), (1, 1.0), (2, 0.5), (4, None)], "id int, p double")
    assert [r["id"] for r in cohort.top_k(s, "p", "id", 2).collect()] == [1, 3]
    assert {r["id"] for r in cohort.rows_at_max(s, "p").collect()} == {1, 3}


def test_expectations(spark):
    a, b = spark.range(3), spark.range(2, 5)
    assert quality.expect_rows(a, 3) is a and quality.expect_rows(a, [spark.range(1), spark.range(2)]) is a
    for bad in (
        lambda: quality.expect_rows(a, 4),
        lambda: quality.expect_disjoint(a, b, "id"),
        lambda: quality.expect_same_columns(a, a.withColumn("x", F.lit(1))),
        lambda: quality.expect_unique(a.union(a), "id"),
    ):
        with pytest.raises(ExpectationFailed):
            bad()
    quality.expect_disjoint(a, spark.range(7, 9), "id")
    audit = quality.null_audit(spark.createDataFrame([(1, None), (None, None)], "x int, y int"))
    assert {tuple(r) for r in audit.collect()} == {("x", 1), ("y", 2)}
