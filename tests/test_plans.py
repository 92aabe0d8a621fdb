"""Whole jobs over small hand-made files."""

import random

import pytest
from pyspark.sql import functions as F

from weaklabel.operators.models import forest_classifier, sensitivity_names
from weaklabel.plans import rounds
from weaklabel.plans.rounds import CohortFiles
from weaklabel.sources import tables as T


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """200 visits of 120 patients, one visit without a start time."""
    root = tmp_path_factory.mktemp("clinic")
    rng = random.Random(7)

    def write(name, header, rows, sep):
        (root / name).write_text("\n".join([sep.join(header), *[sep.join("" if v is None else str(v) for v in r) for r in rows]]) + "\n")
        return str(root / name)

    people, events, drug, counts, conditions = [], [], [], [], []
    for v in range(200):
        owner = rng.randrange(120)
        start = None if v == 13 else "2020-03-01 08:00:00"
        people.append((v, start, "2020-04-20 08:00:00", "1960-01-01 00:00:00", 40 + v % 30, rng.choice(["FEMALE", "MALE"])))
        group = "case" if v % 3 == 0 else "control"
        for day in range(rng.randint(1, 6)):
            stamp = f"2020-{3 + day // 3:02d}-{1 + day:02d} 00:00:00"
            events.append((v, owner, f"G{owner}", group, rng.choice([0, 1, None]), rng.choice(["Yes", "No", None]), None, stamp, stamp, stamp))
        if v % 2:
            drug.append((v, round(rng.random(), 3)))
        if v % 5:
            counts.append((v, *[rng.choice([0, 0, 0, 1, 2]) for _ in T.COUNT_COLUMNS]))
        if v % 7 == 0:
            conditions.append((v, *[rng.choice([1, None]) for _ in T.CONDITION_COLUMNS]))
    upper = lambda s: [f.name.upper() for f in s.fields]
    lower = lambda s: [f.name for f in s.fields]
    return CohortFiles(
        write("people.tsv", upper(T.DEMOGRAPHICS), people, "\t"),
        write("events.psv", upper(T.EVENT_ROWS), events, "|"),
        write("drug.tsv", lower(T.DRUG_PROBABILITY), drug, "\t"),
        write("counts.csv", lower(T.REGEX_COUNTS), counts, ","),
        write("conditions.csv", lower(T.CONFOUNDERS), conditions, ","),
        write("test_cases.csv", ["visit_occurrence_id"], [(v,) for v in range(0, 30, 3)], ","),
        write("test_controls.csv", ["visit_occurrence_id"], [(v,) for v in range(1, 31, 3)], ","),
    )


@pytest.fixture(scope="module")
def cohort(spark, files):
    return rounds.build_cohort(spark, files).persist()


def test_cohort_has_one_row_per_visit(cohort):
    assert cohort.count() == 199, "the visit without a start time is dropped"
    assert cohort.select("visit_occurrence_id").distinct().count() == 199
    row = cohort.where("visit_occurrence_id = 0").first()
    n = row["eligible_vent"].count(";;")
    assert row["respiratory_failure_any"].count(";;") == n
    assert set(row["numerator_condition_start_date"].split(";;")) == {"NaT"}
    assert cohort.where("visit_occurrence_id = 10").first()["counts_hypoxia"] is None
    assert cohort.where("has_confounder").count() == 29


def test_refresh_keeps_rows_and_replaces_families(spark, cohort, files):
    stale = cohort.withColumns({"counts_old": F.lit(1), "cond_old": F.lit(1)})
    fresh = rounds.refresh_numbers(spark, stale, files)
    assert fresh.count() == 199 and sorted(fresh.columns) == sorted(cohort.columns)


def test_all_rounds_then_final_model(spark, cohort, files, tmp_path):
    split = rounds.split_cohort(spark, cohort, files, review_size=30)
    labelled = split.withColumn("label", F.when(F.col("split").isin("dev", "valid"), F.col("study_group")))
    store = T.RoundStore(spark, str(tmp_path / "rounds"))
    rules = rounds.respiratory_rounds()
    gold = F.when(F.col("label") == "case", 1).otherwise(0)
    models = rounds.label_rounds(labelled, store, rules, "visit_occurrence_id", gold=gold, k=6, n_epochs=200)
    assert list(models) == [1, 2, 3, 4]
    base = {r["split"]: r["count"] for r in store.load(1).groupBy("split").count().collect()}
    last = {r["split"]: r["count"] for r in store.load(5).groupBy("split").count().collect()}
    assert last["train"] == base["train"] - 24
    assert last["dev"] == base["dev"] + 12 and last["valid"] == base["valid"] + 12
    assert last["test"] == base["test"] and last.get("excluded") == base.get("excluded")

    done = store.load(5).where("split <> 'excluded'")
    probs = rounds.final_probabilities(done, rules[4], models[4], "visit_occurrence_id")
    assert probs.where("p_model < 0 OR p_model > 1").count() == 0
    frame = rounds.clinical_features(done.join(probs.withColumnRenamed("p_model", "prob_case"), "visit_occurrence_id"))
    frame = frame.withColumn("binary_naloxone_admin", F.lit(0))
    trained, scored = rounds.train_final(frame, "visit_occurrence_id", trees=5, depth=50)
    assert trained.columns[0] == "age_on_admission" and trained.model.getMaxDepth() == 30
    assert scored.count() == done.count()
    assert scored.where("split = 'test' AND outcome IS NULL").count() == 0
    reviewed = scored.where("split = 'test'").select("visit_occurrence_id", (F.col("y") * 1.0).alias("outcome"))
    sweep = rounds.evaluate_scores(
        reviewed.withColumn("agreement", F.lit(1.0)),
        scored.select("visit_occurrence_id", "model_prob"),
        ["visit_occurrence_id"],
        ["model_prob"],
    )
    assert [r["tp"] + r["fp"] + r["tn"] + r["fn"] for r in sweep.collect()] == [reviewed.count()] * 4


def test_sensitivity_names_and_table(spark):
    rows = spark.range(60).select(
        "id",
        F.when(F.col("id") < 50, "train").otherwise("test").alias("split"),
        (F.col("id") % 2).cast("double").alias("y"),
        (F.col("id") % 3 == 0).cast("double").alias("g"),
        F.lit(0.5).alias("weight"),
        (F.col("id") % 7).cast("double").alias("x"),
    )
    from weaklabel.operators.features import assemble

    wide = rounds.sensitivity_table(
        assemble(rows, ["x"]), "id", lambda w: forest_classifier(3, 3, weight=w), {"blended": "y", "generative": "g"}
    )
    assert wide.columns == ["id", *sensitivity_names(["blended", "generative"])]
    assert wide.count() == 60
