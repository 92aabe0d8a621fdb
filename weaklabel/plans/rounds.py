"""Whole jobs: build a cohort, label it over several rounds, train on the soft labels, evaluate."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weaklabel.operators import respiratory
from weaklabel.operators.cohort import collapse, enrich, outer_join, refresh_features, with_membership
from weaklabel.operators.evaluate import adjudicated_set, threshold_sweep
from weaklabel.operators.features import (
    CLINICAL_EQUALS,
    CLINICAL_TEXTS,
    assemble,
    binary_features,
    blended_outcome,
    confidence_weight,
    feature_columns,
    feature_matrix,
    fill_outcome_from_label,
    hard_target,
    probability_limits,
    scaling,
    standardize,
    treatment_flag,
)
from weaklabel.operators.forest import ForestLearner
from weaklabel.operators.label_model import LabelModel
from weaklabel.operators.models import forest_classifier, score, sensitivity_variants, with_class_weight
from weaklabel.operators.quality import expect_rows
from weaklabel.operators.rules import RuleSet
from weaklabel.operators.split import make_splits, promote
from weaklabel.operators.votes import majority_prob
from weaklabel.session import written
from weaklabel.sources import tables
from weaklabel.sources.tables import RoundStore, read_delimited

VISIT = "visit_occurrence_id"
#: The score of a round in the stored table; final scores come under their own name.
ROUND_SCORE = "round_prob_case"
LIST_COLUMNS = {
    "respiratory_failure_any": "nan",
    "eligible_vent": "nan",
    "numerator_condition_start_date": "NaT",
    "numerator_procedure_date": "NaT",
}


@dataclass(frozen=True)
class CohortFiles:
    """Where the clinical input tables lie."""

    demographics: str
    events: str
    drug_probability: str
    regex_counts: str
    confounders: str
    test_cases: str
    test_controls: str


def build_cohort(spark: SparkSession, files: CohortFiles) -> DataFrame:
    """Scan, join and collapse to one row per visit, then attach probabilities, counts and conditions."""
    upper = [f.name.upper() for f in tables.DEMOGRAPHICS.fields]
    people = read_delimited(spark, files.demographics, tables.DEMOGRAPHICS, sep="\t", file_columns=upper)
    upper = [f.name.upper() for f in tables.EVENT_ROWS.fields]
    events = read_delimited(spark, files.events, tables.EVENT_ROWS, sep="|", file_columns=upper)
    people = people.select(VISIT, "visit_start_datetime", "visit_end_datetime", "age_on_admission", "gender")
    rows = outer_join(events, people, [VISIT])
    expect_rows(rows, events)
    keys = [VISIT, "grid", "person_id", "study_group", "visit_start_datetime", "age_on_admission", "gender"]
    # the day an event row stands for orders the lists and cuts a long stay into months
    grouped = collapse(
        rows,
        keys,
        LIST_COLUMNS,
        ["procedure_date", *LIST_COLUMNS],
        segment=F.coalesce(F.trunc("procedure_date", "month"), F.lit("9999-01-01").cast("date")),
    ).withColumnsRenamed({f"{c}_list": c for c in LIST_COLUMNS})
    return attach_numbers(spark, grouped, files)


def attach_numbers(spark: SparkSession, grouped: DataFrame, files: CohortFiles) -> DataFrame:
    drug = read_delimited(spark, files.drug_probability, tables.DRUG_PROBABILITY, sep="\t")
    drug = drug.withColumnsRenamed({"tf_model_prob": "naloxone_admin_prob"})
    counts = read_delimited(spark, files.regex_counts, tables.REGEX_COUNTS)
    conditions = read_delimited(spark, files.confounders, tables.CONFOUNDERS)
    full = enrich(grouped, drug, counts, conditions, on=[VISIT])
    return with_membership(full, conditions, VISIT, "has_confounder")


def refresh_numbers(spark: SparkSession, frame: DataFrame, files: CohortFiles) -> DataFrame:
    """Replace the count and condition families of any frame, all splits at once."""
    counts = read_delimited(spark, files.regex_counts, tables.REGEX_COUNTS)
    conditions = read_delimited(spark, files.confounders, tables.CONFOUNDERS)
    fresh = refresh_features(frame.drop("has_confounder"), {"counts_": counts, "cond_": conditions}, on=[VISIT])
    return with_membership(fresh, conditions, VISIT, "has_confounder")


def split_cohort(spark: SparkSession, cohort: DataFrame, files: CohortFiles, review_size: int = 50) -> DataFrame:
    lists = [read_delimited(spark, p, tables.ID_LIST) for p in (files.test_cases, files.test_controls)]
    return make_splits(cohort, VISIT, "person_id", "study_group", lists, review_size)


def label_round(
    frame: DataFrame,
    rules: RuleSet,
    key: str,
    class_balance: Sequence[float] | None = None,
    gold: Column | None = None,
    k: int = 20,
    **options,
) -> tuple[DataFrame, LabelModel]:
    """Vote, fit on train, score everything, move the ``k`` best train rows to review.

    Without a class balance the dev split's gold labels give it.
    """
    keep = [c for c in frame.columns if c not in rules.names and c not in ("prob_case", ROUND_SCORE)]
    votes = rules.apply(frame.select(*keep), keep)
    dev = None
    if class_balance is None:
        dev = (votes.where(F.col("split") == "dev").select(gold.alias("__gold")), "__gold")
    train = votes.where(F.col("split") == "train")
    model = LabelModel.fit(train, rules.names, class_balance, dev, **options)
    scored = model.score(votes)
    return promote(scored, key, "prob_case", k), model


def label_rounds(
    frame: DataFrame,
    store: RoundStore,
    rule_sets: Mapping[int, RuleSet],
    key: str,
    class_balance: Sequence[float] | None = None,
    gold: Column | None = None,
    refresh: Callable[[DataFrame, int], DataFrame] | None = None,
    **options,
) -> dict[int, LabelModel]:
    """Run rounds one after the other; each round's table is written and the next reads it.

    The written table is the hand-over to reviewers and also cuts the lineage, so a lost
    executor costs one round at most. ``refresh`` may attach new labels or features.
    """
    numbers = sorted(rule_sets)
    store.write(frame, numbers[0])
    models = {}
    for n in numbers:
        current = store.load(n).drop("round")
        if refresh:
            current = refresh(current, n)
        moved, models[n] = label_round(current, rule_sets[n], key, class_balance, gold, **options)
        # the score goes to the reviewers with the rows
        own = [c for c in frame.columns if c not in ("prob_case", ROUND_SCORE)]
        store.write(moved.select(*own, F.col("prob_case").alias(ROUND_SCORE)), n + 1)
    return models


@dataclass
class Trained:
    model: Model
    columns: list[str]
    scaling: DataFrame
    limits: DataFrame


def soft_targets(frame: DataFrame, prob: str = "prob_case") -> tuple[DataFrame, DataFrame]:
    """Add outcome, y and weight; valid rows take their outcome from their label."""
    limits = probability_limits(frame.where(F.col("split").isin("train", "dev")), prob)
    learned = blended_outcome(frame, prob, limits=limits)
    open_valid = F.when(F.col("split") != "valid", F.col("outcome"))
    done = fill_outcome_from_label(learned.withColumn("outcome", open_valid), limits)
    return done.withColumns({"y": hard_target("outcome"), "weight": confidence_weight(prob)}), limits


def clinical_features(frame: DataFrame, drug_rows: DataFrame | None = None) -> DataFrame:
    if drug_rows is not None:
        given = treatment_flag(drug_rows, [VISIT, "grid", "label"], "x_doc_type").groupBy(VISIT)
        frame = enrich(frame, given.agg(F.max("binary_naloxone_admin").alias("binary_naloxone_admin")), on=[VISIT], check=False)
        frame = frame.fillna({"binary_naloxone_admin": 0})
    return binary_features(frame, CLINICAL_TEXTS, CLINICAL_EQUALS)


def train_final(
    frame: DataFrame,
    key: str,
    first: Sequence[str] = ("age_on_admission",),
    prob: str = "prob_case",
    trees: int = 1000,
    depth: int | None = 50,
    class_weight: Mapping[int, float] | None = None,
    exact: bool = False,
) -> tuple[Trained, DataFrame]:
    """Refit on train + dev + valid with sample and class weights and score every split.

    Scaling is fitted on train + dev only. ``exact`` grows the trees over all distinct values to any depth; Spark's
    forest bins values and stops at depth 30. Returns the model and (key, split, outcome, y, model_prob, model_class)
    for all rows, test included.
    """
    targets, limits = soft_targets(frame, prob)
    columns = feature_columns(targets, first)
    keep = [key, "split", "outcome", "y", "weight"]
    matrix = feature_matrix(targets, columns, keep)
    fitted = scaling(matrix.where(F.col("split").isin("train", "dev")), columns)
    # what is scored has the very features that were learned from
    ready = written(assemble(standardize(matrix, columns, fitted), columns).select(*keep, "features"), "final-rows")
    known = ready.where(F.col("split").isin("train", "dev", "valid"))
    weighted = written(with_class_weight(known, class_weight or {0: 0.99, 1: 0.01}, "weight", "w"), "final-training")
    learner = ForestLearner(trees, depth, weight="w", key=key) if exact else forest_classifier(trees, depth, None, "w")
    model = learner.fit(weighted)
    scored = score(model, ready, "model_prob", "model_class")
    return Trained(model, columns, fitted, limits), scored.drop("features", "weight")


def sensitivity_table(
    ready: DataFrame, key: str, make: Callable[[str | None], Estimator], targets: Mapping[str, str], weight: str = "weight"
) -> DataFrame:
    """All four target x weighting variants in one wide table, trained without the test split."""
    known = ready.where(F.col("split").isin("train", "dev", "valid"))
    return sensitivity_variants(known, ready, make, targets, weight, key)


def evaluate_scores(
    reviewed: DataFrame,
    scored: DataFrame,
    keys: Sequence[str],
    scores: Sequence[str],
    thresholds: Sequence[float] = (0.5, 0.7, 0.8, 0.9),
    overrides: DataFrame | None = None,
) -> DataFrame:
    """Adjudicated rows joined to every model's score, all metrics for all thresholds."""
    return threshold_sweep(adjudicated_set(reviewed, scored, keys, overrides), "outcome", scores, thresholds)


def respiratory_rounds() -> dict[int, RuleSet]:
    """The rule sets that rounds 1-4 settled on."""
    return {n: respiratory.respiratory_rules_after_review(n) for n in (1, 2, 3, 4)}


def final_probabilities(frame: DataFrame, rules: RuleSet, model: LabelModel, key: str) -> DataFrame:
    """(key, majority and model probability) for hand-over to training."""
    votes = rules.apply(frame, [key])
    return votes.select(key, majority_prob(rules.names).alias("p_majority"), model.prob_case().alias("p_model"))
