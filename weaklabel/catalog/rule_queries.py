"""Rules, votes and label models over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weaklabel.catalog import views
from weaklabel.catalog.registry import query
from weaklabel.catalog.views import DOC_RULES, FIXED_MU, PRIOR, as_int, r6
from weaklabel.operators import respiratory
from weaklabel.operators.label_model import LabelModel, accuracies_by_triples, accuracy, tune, vote_pairs, vote_patterns
from weaklabel.operators.rules import (
    CASE,
    CONTROL,
    Rule,
    RuleSet,
    all_zero,
    at_least,
    consecutive_entries,
    consecutive_text,
    evidence_sum,
    ladder,
    present,
    text_has,
    veto,
)
from weaklabel.operators.cohort import melt
from weaklabel.operators.evaluate import auc_of_scores, confusion, metrics
from weaklabel.operators.votes import (
    bucket_rows,
    explain_votes,
    filter_unlabeled,
    label_buckets,
    misclassified,
    prediction,
    rule_summary,
    with_majority,
    with_weights,
)

_V = ", ".join(DOC_RULES)


@query("J0 J1 J3", "WITH " + views.DOC_VOTES_SQL + f"SELECT unit_id, {_V} FROM doc_votes")
def apply_rules(spark: SparkSession, folder: str) -> DataFrame:
    return as_int(views.doc_votes(spark, folder)).select("unit_id", *DOC_RULES)


@query("J2", "WITH " + views.DOC_VOTES_SQL + "SELECT unit_id, LF_emph, LF_newline, LF_license FROM doc_votes")
def rules_without(spark: SparkSession, folder: str) -> DataFrame:
    kept = views.doc_rules().without("LF_short", "LF_long")
    return as_int(kept.apply(views.doc_features(spark, folder), ["unit_id"]), kept.names)


@query(
    "J0",
    "WITH "
    + views.CLINICAL_SQL
    + """
SELECT visit_occurrence_id,
       CASE WHEN naloxone_admin_prob >= 0.8 THEN 1 WHEN naloxone_admin_prob < 0.8 THEN 0 ELSE -1 END AS LF_threshold,
       CASE WHEN counts_naloxone_effective > 0 THEN 1 WHEN counts_naloxone_NOT_effective > 0 THEN 0 ELSE -1 END AS LF_ladder,
       CASE WHEN has_confounder THEN 0 WHEN counts_rapid_response > 0 THEN 1 ELSE -1 END AS LF_veto,
       CASE WHEN counts_naloxone = 0 AND counts_hypoxia = 0 AND naloxone_admin_prob IS NULL THEN 0 ELSE -1 END AS LF_quiet,
       CASE WHEN contains(lower(eligible_vent), 'yes;;yes;;yes;;yes') THEN 0 ELSE -1 END AS LF_run_text,
       CASE WHEN contains(concat(';;', lower(eligible_vent), ';;'), ';;yes;;yes;;yes;;yes;;') THEN 0 ELSE -1 END AS LF_run_entries,
       CASE WHEN counts_no_acute_events > 0 THEN
         CASE WHEN counts_naloxone + counts_hypoxia > 0 THEN -1 ELSE 0 END ELSE -1 END AS LF_evidence,
       CASE WHEN contains(lower(respiratory_failure_any), '1') THEN 1 ELSE -1 END AS LF_text
FROM clinical
""",
)
def rule_templates(spark: SparkSession, folder: str) -> DataFrame:
    note = F.col("counts_no_acute_events") > 0
    rules = RuleSet(
        [
            Rule("LF_threshold", at_least("naloxone_admin_prob", 0.8, CASE, below=CONTROL)),
            Rule(
                "LF_ladder",
                ladder((F.col("counts_naloxone_effective") > 0, CASE), (F.col("counts_naloxone_NOT_effective") > 0, CONTROL)),
            ),
            Rule("LF_veto", veto("has_confounder", CONTROL, present("counts_rapid_response", CASE))),
            Rule(
                "LF_quiet",
                ladder((all_zero("counts_naloxone", "counts_hypoxia") & F.col("naloxone_admin_prob").isNull(), CONTROL)),
            ),
            Rule("LF_run_text", ladder((consecutive_text("eligible_vent", "yes", 4), CONTROL))),
            Rule("LF_run_entries", ladder((consecutive_entries("eligible_vent", "yes", 4), CONTROL))),
            Rule(
                "LF_evidence",
                F.when(note, ladder((evidence_sum("counts_naloxone", "counts_hypoxia") > 0, -1), otherwise=CONTROL)),
            ),
            Rule("LF_text", ladder((text_has("respiratory_failure_any", "1"), CASE))),
        ]
    )
    return as_int(rules.apply(views.clinical(spark, folder), ["visit_occurrence_id"]), rules.names)


# The clinical rules written a second time, as SQL, per version.
_EFFECT_OLD = "CASE WHEN counts_naloxone_effective > 0 THEN 1 WHEN counts_naloxone_NOT_effective > 0 THEN 0 ELSE 1 END"
_EFFECT_NEW = "CASE WHEN counts_naloxone_NOT_effective > counts_naloxone_effective THEN 0 ELSE " + _EFFECT_OLD + " END"
_QUIET = (
    "counts_naloxone = 0 AND naloxone_admin_prob IS NULL AND counts_altered_mental_status = 0 AND "
    "counts_narcotic_overdose = 0 AND counts_hypoxia = 0 AND counts_decrease_opioids = 0"
)
_ACUTE = "counts_naloxone + counts_rapid_response + counts_altered_mental_status + counts_narcotic_overdose + counts_hypoxia"


def _drug_sql(limit: float, effect: str, missing: int) -> str:
    return (
        f"CASE WHEN naloxone_admin_prob >= {limit} THEN {effect} WHEN naloxone_admin_prob < {limit} THEN 0 ELSE {missing} END"
    )


def _vote_sql(version: int) -> dict[str, str]:
    late, effect = version >= 4, _EFFECT_NEW if version >= 4 else _EFFECT_OLD
    failed, vent = "contains(respiratory_failure_any, '1')", "contains(lower(eligible_vent), 'yes')"
    acute = _ACUTE + (" + counts_held_opioids" if late else "")
    more = " AND counts_rapid_response = 0" + (" AND counts_held_opioids = 0 AND counts_pinpoint_pupils = 0" if late else "")
    confounded = -1 if late else 0
    failure = {
        1: f"CASE WHEN {failed} THEN 1 ELSE 0 END",
        2: f"CASE WHEN NOT {failed} THEN 0 WHEN has_confounder THEN 0 WHEN {_QUIET} THEN 0 ELSE 1 END",
    }.get(version, f"CASE WHEN {failed} AND {vent} THEN 0 ELSE -1 END")
    altered = "1" if version == 2 else f"CASE WHEN has_confounder THEN {confounded} ELSE 1 END"
    out = {
        "LF_naloxone_admin": _drug_sql(0.8 if late else 0.75, "1" if version == 1 else effect, 0 if late else -1),
        "LF_counts_naloxone": f"CASE WHEN counts_naloxone > 0 THEN {'1' if version <= 2 else effect} ELSE -1 END",
        "LF_respiratory_failure_any": failure,
        "LF_eligible_vent": f"CASE WHEN {vent} THEN 1 ELSE -1 END",
        "LF_counts_resp_care_notes": "CASE WHEN counts_resp_care_notes = 0 THEN 0 ELSE -1 END",
        "LF_counts_rapid_response": "CASE WHEN counts_rapid_response > 0 THEN 1 ELSE 0 END",
        "LF_counts_no_acute_events": f"CASE WHEN counts_no_acute_events > 0 THEN CASE WHEN {acute} > 0 THEN -1 ELSE 0 END ELSE -1 END",
        "LF_counts_altered_mental_status": f"CASE WHEN counts_altered_mental_status > 0 THEN {altered} ELSE -1 END",
        "LF_confounding_diagnosis_for_rrt": f"CASE WHEN has_confounder THEN {confounded} WHEN counts_rapid_response > 0 THEN 1 ELSE -1 END",
        "LF_extended_vent_time": "CASE WHEN contains(lower(eligible_vent), 'yes;;yes;;yes;;yes') THEN 0 ELSE -1 END",
        "LF_extended_respiratory_failure": "CASE WHEN contains(respiratory_failure_any, '1;;1;;1;;1') THEN 0 ELSE -1 END",
        "LF_no_support": f"CASE WHEN {_QUIET}{more} AND NOT {failed} THEN 0 ELSE -1 END",
    }
    for name, column, vote, _first in respiratory.PRESENCE:
        out[name] = f"CASE WHEN {column} > 0 THEN {vote} ELSE -1 END"
    return {n: out[n] for n in respiratory.ORDER[version]}


def _clinical_sql(version: int) -> str:
    votes = ", ".join(f"{expr} AS {name}" for name, expr in _vote_sql(version).items())
    return "WITH " + views.CLINICAL_SQL + f"SELECT visit_occurrence_id, {votes} FROM clinical"


def _clinical_votes(spark: SparkSession, folder: str, version: int) -> DataFrame:
    rules = respiratory.respiratory_rules(version)
    return as_int(rules.apply(views.clinical(spark, folder), ["visit_occurrence_id"]), rules.names)


@query("J0 J3", _clinical_sql(1))
def respiratory_votes_round_1(spark: SparkSession, folder: str) -> DataFrame:
    return _clinical_votes(spark, folder, 1)


@query("J0 J3", _clinical_sql(2))
def respiratory_votes_round_2(spark: SparkSession, folder: str) -> DataFrame:
    return _clinical_votes(spark, folder, 2)


@query("J0 J3", _clinical_sql(3))
def respiratory_votes_round_3(spark: SparkSession, folder: str) -> DataFrame:
    return _clinical_votes(spark, folder, 3)


@query("J0 J3", _clinical_sql(4))
def respiratory_votes_round_4(spark: SparkSession, folder: str) -> DataFrame:
    return _clinical_votes(spark, folder, 4)


@query("J0 J3", _clinical_sql(5))
def respiratory_votes_final(spark: SparkSession, folder: str) -> DataFrame:
    return _clinical_votes(spark, folder, 5)


def _summary_sql(gold: bool) -> str:
    parts = []
    for i, r in enumerate(DOC_RULES):
        against = f"CASE WHEN {r} = 1 THEN n_control ELSE n_case END"
        extra = ""
        if gold:
            extra = (
                f", count(*) FILTER ({r} <> -1 AND {r} = gold) AS correct, count(*) FILTER ({r} <> -1 AND {r} <> gold) AS incorrect, "
                f"round(count(*) FILTER ({r} <> -1 AND {r} = gold) / nullif(count(*) FILTER ({r} <> -1), 0), 6) AS emp_acc"
            )
        parts.append(
            f"SELECT {i} AS position, '{r}' AS rule, concat_ws(',', CASE WHEN bool_or({r} = 0) THEN '0' END, "
            f"CASE WHEN bool_or({r} = 1) THEN '1' END) AS polarity, "
            f"round(count(*) FILTER ({r} <> -1) / count(*), 6) AS coverage, "
            f"round(count(*) FILTER ({r} <> -1 AND n_case + n_control > 1) / count(*), 6) AS overlaps, "
            f"round(count(*) FILTER ({r} <> -1 AND {against} > 0) / count(*), 6) AS conflicts{extra} "
            f"FROM doc_tally{' WHERE gold IS NOT NULL' if gold else ''}"
        )
    return "WITH " + views.DOC_VOTES_SQL + " UNION ALL ".join(parts)


@query("K1", _summary_sql(False))
def rule_summary_table(spark: SparkSession, folder: str) -> DataFrame:
    out = rule_summary(views.doc_votes(spark, folder), DOC_RULES)
    return out.withColumns({c: r6(c) for c in ("coverage", "overlaps", "conflicts")})


@query("K2", _summary_sql(True))
def rule_summary_gold(spark: SparkSession, folder: str) -> DataFrame:
    known = views.doc_votes(spark, folder).where(F.col("gold").isNotNull())
    out = rule_summary(known, DOC_RULES, gold="gold")
    return out.withColumns({c: r6(c) for c in ("coverage", "overlaps", "conflicts", "emp_acc")})


def _triples_sql() -> str:
    both = lambda a, b: f"{a} <> -1 AND {b} <> -1"
    pairs = [
        f"SELECT {i} AS a, {j} AS b, 2.0::DOUBLE * count(*) FILTER ({a} = {b} AND {both(a, b)}) / nullif(count(*) FILTER ({both(a, b)}), 0) - 1 AS e FROM doc_votes"
        for i, a in enumerate(DOC_RULES)
        for j, b in enumerate(DOC_RULES)
        if i < j
    ]
    return f"""
s AS ({_summary_sql(False).removeprefix("WITH " + views.DOC_VOTES_SQL)}),
p AS ({" UNION ALL ".join(pairs)}),
e AS (SELECT a, b, e FROM p WHERE e IS NOT NULL UNION ALL SELECT b, a, e FROM p WHERE e IS NOT NULL),
t AS (SELECT x.a, avg(least(sqrt(abs(x.e * y.e / z.e)), 1.0::DOUBLE)) AS m FROM e x JOIN e y ON x.a = y.a AND x.b < y.b JOIN e z ON z.a = x.b AND z.b = y.b
      WHERE z.e <> 0 GROUP BY x.a)"""


@query(
    "K3 K6 K8 F2",
    "WITH " + views.DOC_VOTES_SQL + "," + _triples_sql() + " SELECT s.*, round((1 + m) / 2, 6) AS learned_weight FROM s LEFT JOIN t ON t.a = s.position",
)
def rule_summary_weights(spark: SparkSession, folder: str) -> DataFrame:
    """The summary with accuracies from the agreement rates of triples of rules."""
    votes = views.doc_votes(spark, folder)
    learned = accuracies_by_triples(vote_pairs(vote_patterns(votes, DOC_RULES), DOC_RULES), DOC_RULES)
    summary = rule_summary(votes, DOC_RULES).join(learned.drop("n_triples"), "rule")
    rounded = summary.withColumns({c: r6(c) for c in ("coverage", "overlaps", "conflicts", "learned_weight")})
    return rounded.orderBy(F.col("learned_weight").desc())


@query("K3 K8 F2")
def rule_summary_fitted(spark: SparkSession, folder: str) -> DataFrame:
    """The summary with the weights of the iterative fit."""
    votes = views.doc_votes(spark, folder)
    model = LabelModel.fit(votes, DOC_RULES, class_balance=PRIOR)
    return with_weights(rule_summary(votes, DOC_RULES), model.weights()).orderBy(F.col("learned_weight").desc())


def _fixed_weights_sql() -> str:
    parts = []
    for r in DOC_RULES:
        (c0, _), (_, k1) = FIXED_MU[r]
        right = f"({c0}::DOUBLE * {PRIOR[0]} + {k1}::DOUBLE * {PRIOR[1]})"
        coverage = f"(count(*) FILTER ({r} <> -1) / count(*))"
        parts.append(
            f"SELECT '{r}' AS rule, round(least(greatest({right} / {coverage}, 1e-6), 1.0), 6) AS learned_weight FROM doc_votes"
        )
    return "WITH " + views.DOC_VOTES_SQL + " UNION ALL ".join(parts)


@query("K8", _fixed_weights_sql())
def weights_from_parameters(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy per rule from given P(vote | class) and the coverage seen in the votes."""
    model = views.fixed_model()
    summary = rule_summary(views.doc_votes(spark, folder), DOC_RULES)
    right = {
        n: float(model.mu[2 * r, 0] * PRIOR[0] + model.mu[2 * r + 1, 1] * PRIOR[1]) for r, n in enumerate(DOC_RULES)
    }
    agree = with_weights(summary, right)
    weight = F.least(F.greatest(F.try_divide("learned_weight", "coverage"), F.lit(1e-6)), F.lit(1.0))
    return agree.select("rule", r6(weight).alias("learned_weight"))


@query(
    "K4",
    "WITH "
    + views.DOC_VOTES_SQL
    + "SELECT LF_emph, LF_newline, count(*) AS n_rows FROM doc_votes GROUP BY LF_emph, LF_newline",
)
def vote_bucket_counts(spark: SparkSession, folder: str) -> DataFrame:
    return label_buckets(as_int(views.doc_votes(spark, folder)), "LF_emph", "LF_newline")


@query(
    "K4 B16",
    "WITH " + views.DOC_VOTES_SQL + "SELECT unit_id, LF_emph AS vote_a, LF_newline AS vote_b FROM doc_votes",
)
def vote_bucket_rows(spark: SparkSession, folder: str) -> DataFrame:
    return bucket_rows(as_int(views.doc_votes(spark, folder)), "LF_emph", "LF_newline", "unit_id")


@query("K5", "WITH " + views.DOC_VOTES_SQL + "SELECT unit_id, prob_case, 1 - prob_case AS prob_control FROM doc_majority")
def majority_vote(spark: SparkSession, folder: str) -> DataFrame:
    return with_majority(views.doc_votes(spark, folder), DOC_RULES).select("unit_id", "prob_case", "prob_control")


@query(
    "K5 K9 K11 N1 N2 N6",
    "WITH "
    + views.DOC_VOTES_SQL
    + """,
c AS (SELECT count(*) FILTER (prob_case >= 0.75 AND gold = 1) AS tp, count(*) FILTER (prob_case >= 0.75 AND gold = 0) AS fp,
             count(*) FILTER (prob_case < 0.75 AND gold = 0) AS tn, count(*) FILTER (prob_case < 0.75 AND gold = 1) AS fn
      FROM doc_majority)
SELECT 'prob_case' AS model, 0.75::DOUBLE AS threshold, tp, fp, tn, fn,
       round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision,
       round(tp / (tp + fn), 6) AS recall, round(tn / (tn + fp), 6) AS specificity,
       round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS auc
FROM c
""",
)
def majority_vote_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Flagship: rules on whole texts, majority vote, exact metrics against gold."""
    scored = with_majority(views.doc_votes(spark, folder), DOC_RULES)
    out = metrics(confusion(scored, "gold", ["prob_case"], [0.75]))
    return out.withColumns({c: r6(c) for c in ("accuracy", "precision", "recall", "specificity", "f1", "auc")})


@query(
    "K6",
    "WITH " + views.DOC_VOTES_SQL + f"SELECT {_V}, count(*) AS n_rows FROM doc_votes GROUP BY {_V}",
)
def vote_pattern_counts(spark: SparkSession, folder: str) -> DataFrame:
    return vote_patterns(as_int(views.doc_votes(spark, folder)), DOC_RULES)


def _pairs_sql() -> str:
    items = [(2 * r + v, f"{n} = {v}") for r, n in enumerate(DOC_RULES) for v in (0, 1)]
    parts = [
        f"SELECT {i} AS i, {j} AS j, count(*) FILTER ({a} AND {b}) AS n_rows FROM doc_votes"
        for i, a in items
        for j, b in items
        if i <= j
    ]
    return "WITH " + views.DOC_VOTES_SQL + "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE n_rows > 0"


@query("K6", _pairs_sql())
def vote_pair_counts(spark: SparkSession, folder: str) -> DataFrame:
    return vote_pairs(vote_patterns(views.doc_votes(spark, folder), DOC_RULES), DOC_RULES)


@query("K6 K8")
def label_model_fit(spark: SparkSession, folder: str) -> DataFrame:
    model = LabelModel.fit(views.doc_votes(spark, folder), DOC_RULES, class_balance=PRIOR, starts=(None, 123, 987))
    return model.parameters(spark)


@query("K6 K7 K16")
def label_model_probability(spark: SparkSession, folder: str) -> DataFrame:
    votes = views.doc_votes(spark, folder)
    gold = votes.where(F.col("gold").isNotNull())
    model = LabelModel.fit(votes, DOC_RULES, gold=(gold, "gold"))
    return with_majority(votes, DOC_RULES).select(
        "unit_id", F.col("prob_case").alias("p_majority"), model.prob_case().alias("p_model")
    )


@query("K6 K7")
def respiratory_label_model(spark: SparkSession, folder: str) -> DataFrame:
    """The 14 final clinical rules, fitted with the study's class balance and scored."""
    rules = respiratory.respiratory_rules()
    votes = rules.apply(views.clinical(spark, folder), ["visit_occurrence_id"])
    model = LabelModel.fit(votes, rules.names, class_balance=(0.985, 0.015), lr_scheduler="step", lr=0.01, starts=(987,))
    return model.score(votes).select("visit_occurrence_id", "prob_case")


@query("K7", "WITH " + views.DOC_SCORED_SQL + "SELECT unit_id, p_model FROM doc_scored")
def label_model_score(spark: SparkSession, folder: str) -> DataFrame:
    return views.doc_scored(spark, folder).select("unit_id", "p_model")


@query(
    "K9",
    "WITH "
    + views.DOC_VOTES_SQL
    + """
SELECT count(*) AS n_rows, round(avg((CASE WHEN prob_case > 0.5 THEN 1 ELSE 0 END = gold)::INT), 6) AS accuracy
FROM doc_majority WHERE gold IS NOT NULL AND prob_case <> 0.5
""",
)
def model_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    scored = with_majority(views.doc_votes(spark, folder), DOC_RULES).where(F.col("gold").isNotNull())
    return accuracy(scored, "prob_case", "gold", "unit_id").withColumn("accuracy", r6("accuracy"))


@query(
    "K10",
    "WITH "
    + views.DOC_VOTES_SQL
    + """
SELECT unit_id, CASE WHEN prob_case > 0.5 THEN 1 WHEN prob_case < 0.5 THEN 0 ELSE -1 END AS pred_abstain,
       CASE WHEN prob_case > 0.5 THEN 1 WHEN prob_case < 0.5 THEN 0
            WHEN md5(concat(unit_id, ':123')) < '8' THEN 0 ELSE 1 END AS pred_random
FROM doc_majority
""",
)
def predictions_with_ties(spark: SparkSession, folder: str) -> DataFrame:
    scored = with_majority(views.doc_votes(spark, folder), DOC_RULES)
    return scored.select(
        "unit_id",
        prediction("prob_case", "unit_id").alias("pred_abstain"),
        prediction("prob_case", "unit_id", tie="random").alias("pred_random"),
    )


@query(
    "K11 N8",
    "WITH "
    + views.DOC_SCORED_SQL
    + """
SELECT model, round(sum(n_case * (below + n_control / 2)) / (sum(n_case) * sum(n_control)), 6) AS auc FROM (
  SELECT model, score, n_case, n_control,
         sum(n_control) OVER (PARTITION BY model ORDER BY score ROWS UNBOUNDED PRECEDING) - n_control AS below
  FROM (SELECT model, score, count(*) FILTER (gold = 1) AS n_case, count(*) FILTER (gold = 0) AS n_control
        FROM (SELECT 'p_majority' AS model, p_majority AS score, gold FROM doc_scored WHERE gold IS NOT NULL
              UNION ALL SELECT 'p_model', p_model, gold FROM doc_scored WHERE gold IS NOT NULL)
        GROUP BY model, score))
GROUP BY model
""",
)
def auc_of_models(spark: SparkSession, folder: str) -> DataFrame:
    return auc_of_scores(views.doc_scored(spark, folder), "gold", ["p_majority", "p_model"]).withColumn("auc", r6("auc"))


@query(
    "K12",
    "WITH " + views.DOC_VOTES_SQL + f"SELECT unit_id, {_V} FROM doc_votes WHERE LF_emph >= 0 OR LF_license >= 0 OR LF_long >= 0",
)
def drop_unlabeled(spark: SparkSession, folder: str) -> DataFrame:
    # LF_newline always votes, so the sparse rules are the ones that can all abstain
    kept = filter_unlabeled(views.doc_votes(spark, folder), ["LF_emph", "LF_license", "LF_long"])
    return as_int(kept).select("unit_id", *DOC_RULES)


def _explain_sql() -> str:
    long = " UNION ALL ".join(f"SELECT unit_id, '{r}' AS rule, {r} AS vote FROM doc_scored" for r in DOC_RULES)
    return (
        "WITH "
        + views.DOC_SCORED_SQL
        + f"SELECT unit_id, rule, vote FROM ({long}) WHERE vote <> -1 AND unit_id IN "
        + "(SELECT unit_id FROM doc_scored WHERE gold = 1 AND p_model <= 0.5)"
    )


@query("K13 C6", _explain_sql())
def explain_missed_cases(spark: SparkSession, folder: str) -> DataFrame:
    scored = views.doc_scored(spark, folder)
    missed = scored.where((F.col("gold") == 1) & (F.col("p_model") <= 0.5))
    return explain_votes(scored, DOC_RULES, "unit_id", missed).withColumn("vote", F.col("vote").cast("int"))


@query("K14 G4 F5")
def tuning_grid(spark: SparkSession, folder: str) -> DataFrame:
    votes = views.doc_votes(spark, folder)
    return tune(votes, votes, DOC_RULES, "gold", class_balance=PRIOR)


@query("K14 G4")
def tuning_grid_long(spark: SparkSession, folder: str) -> DataFrame:
    votes = views.doc_votes(spark, folder)
    wide = tune(votes, votes, DOC_RULES, "gold", PRIOR)
    # accuracy is not an id column, so it is melted along with the rules
    return melt(wide, ["n_epochs", "lr", "lr_scheduler", "seed"], None, "learning_function", "learned_weight")


@query(
    "K15",
    "WITH "
    + views.DOC_SCORED_SQL
    + """
SELECT unit_id, label, p_model, p_majority FROM doc_scored
WHERE (label = 'case' AND p_model <= 0.5) OR (label = 'control' AND p_model > 0.5)
""",
)
def misclassified_review(spark: SparkSession, folder: str) -> DataFrame:
    return misclassified(views.doc_scored(spark, folder), "label", "p_model").select("unit_id", "label", "p_model", "p_majority")


@query("K16", "WITH " + views.DOC_SCORED_SQL + "SELECT unit_id, p_majority, p_model FROM doc_scored")
def compare_generative(spark: SparkSession, folder: str) -> DataFrame:
    return views.doc_scored(spark, folder).select("unit_id", "p_majority", "p_model")
