"""The clinical rules against a second, row-wise statement of what each version does."""

import itertools

import pytest
from pyspark.sql import functions as F

from weaklabel.operators import rules as R
from weaklabel.operators.respiratory import DROPPED, FINAL, ORDER, respiratory_rules, respiratory_rules_after_review
from weaklabel.sources.tables import COUNT_COLUMNS

BASE = {c: 0 for c in COUNT_COLUMNS} | {
    "id": 0,
    "naloxone_admin_prob": None,
    "respiratory_failure_any": "0",
    "eligible_vent": "No",
    "has_confounder": False,
}
SCHEMA = ", ".join(
    f"{c} " + {"id": "long", "naloxone_admin_prob": "double", "has_confounder": "boolean"}.get(c, "long" if c in COUNT_COLUMNS else "string")
    for c in BASE
)


def votes(spark, version, *changes):
    rows = [tuple((BASE | {"id": i} | c).values()) for i, c in enumerate(changes)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = respiratory_rules(version).apply(df, ["id"]).orderBy("id").collect()
    return [r.asDict() for r in out]


def one(spark, rule, change, version=FINAL):
    return votes(spark, version, change)[0][rule]


@pytest.mark.parametrize("version", [1, 2, 3, 4, FINAL])
def test_drug_record_ladder(spark, version):
    grid = list(itertools.product([None, 0.5, 0.75, 0.79, 0.8, 0.95], [None, 0, 1, 2], [None, 0, 1, 2]))
    changes = [
        {"naloxone_admin_prob": p, "counts_naloxone_effective": e, "counts_naloxone_NOT_effective": n} for p, e, n in grid
    ]
    limit = 0.8 if version >= 4 else 0.75
    for (p, e, n), got in zip(grid, votes(spark, version, *changes), strict=True):
        if p is None:
            want = 0 if version >= 4 else -1
        elif p < limit:
            want = 0
        elif version == 1:
            want = 1
        elif version >= 4 and e is not None and n is not None and n > e:
            want = 0
        elif e is not None and e > 0:
            want = 1
        elif n is not None and n > 0:
            want = 0
        else:
            want = 1
        assert got["LF_naloxone_admin"] == want, (p, e, n)


@pytest.mark.parametrize("version", [1, 2, 3, FINAL])
def test_drug_mention(spark, version):
    grid = list(itertools.product([None, 0, 3], [None, 0, 1], [None, 0, 2]))
    changes = [
        {"counts_naloxone": c, "counts_naloxone_effective": e, "counts_naloxone_NOT_effective": n} for c, e, n in grid
    ]
    for (c, e, n), got in zip(grid, votes(spark, version, *changes), strict=True):
        want = -1
        if c:
            outnumbered = version >= 4 and e is not None and n is not None and n > e
            want = 1
            if version >= 3:
                want = 0 if outnumbered else 1 if e else 0 if n else 1
        assert got["LF_counts_naloxone"] == want, (c, e, n)


def test_failure_rule_by_version(spark):
    grid = list(itertools.product(["0", "0;;1", "nan"], ["No", "Yes;;No", "nan"], [False, True], [0, 1]))
    changes = [
        {"respiratory_failure_any": f, "eligible_vent": v, "has_confounder": c, "counts_hypoxia": h} for f, v, c, h in grid
    ]
    for version in (1, 2, 3, FINAL):
        for (f, v, c, h), got in zip(grid, votes(spark, version, *changes), strict=True):
            if version == 1:
                want = 1 if "1" in f else 0
            elif version == 2:
                want = 0 if "1" not in f or c or h == 0 else 1
            else:
                want = 0 if "1" in f and "Yes" in v else -1
            assert got["LF_respiratory_failure_any"] == want, (version, f, v, c, h)


def test_confounder_veto(spark):
    hit = {"counts_altered_mental_status": 2, "counts_rapid_response": 1}
    for version, vetoed in ((3, 0), (4, -1)):
        plain, blocked = votes(spark, version, hit, hit | {"has_confounder": True})
        assert (plain["LF_counts_altered_mental_status"], blocked["LF_counts_altered_mental_status"]) == (1, vetoed)
        assert (plain["LF_confounding_diagnosis_for_rrt"], blocked["LF_confounding_diagnosis_for_rrt"]) == (1, vetoed)
    assert one(spark, "LF_counts_altered_mental_status", hit | {"has_confounder": True}, 2) == 1
    assert one(spark, "LF_confounding_diagnosis_for_rrt", {"has_confounder": True}, 2) == 0


def test_no_acute_events(spark):
    note = {"counts_no_acute_events": 1}
    assert one(spark, "LF_counts_no_acute_events", note) == 0
    assert one(spark, "LF_counts_no_acute_events", note | {"counts_hypoxia": 1}) == -1
    assert one(spark, "LF_counts_no_acute_events", note | {"counts_hypoxia": None, "counts_naloxone": 4}) == 0
    assert one(spark, "LF_counts_no_acute_events", note | {"counts_held_opioids": 1}) == -1
    assert one(spark, "LF_counts_no_acute_events", note | {"counts_held_opioids": 1}, 3) == 0
    assert one(spark, "LF_counts_no_acute_events", {}) == -1


@pytest.mark.parametrize(
    "text, want",
    [("Yes;;Yes;;Yes;;Yes", 0), ("Yes;;Yes;;Yes", -1), ("Yes;;Yes;;No;;Yes;;Yes", -1), ("No;;yes;;YES;;Yes;;yes", 0), ("nan", -1)],
)
def test_long_ventilation(spark, text, want):
    assert one(spark, "LF_extended_vent_time", {"eligible_vent": text}) == want


def test_long_failure_is_text_based(spark):
    rule = "LF_extended_respiratory_failure"
    assert one(spark, rule, {"respiratory_failure_any": "0;;1;;1;;1;;1"}, 4) == 0
    assert one(spark, rule, {"respiratory_failure_any": "1.0;;1.0;;1.0;;1.0"}, 4) == -1


def test_no_notes_and_all_quiet(spark):
    none = {c: None for c in COUNT_COLUMNS}
    silent, quiet = votes(spark, FINAL, none, {})
    assert silent["LF_counts_resp_care_notes"] == -1 and silent["LF_no_support"] == -1
    assert quiet["LF_counts_resp_care_notes"] == 0 and quiet["LF_no_support"] == 0


@pytest.mark.parametrize("version", [3, 4, FINAL])
def test_any_signal_ends_no_support(spark, version):
    signals = [
        "counts_naloxone",
        "counts_altered_mental_status",
        "counts_narcotic_overdose",
        "counts_hypoxia",
        "counts_decrease_opioids",
        "counts_rapid_response",
    ]
    late = ["counts_held_opioids", "counts_pinpoint_pupils"]
    got = votes(
        spark,
        version,
        *[{s: 1} for s in signals],
        {"naloxone_admin_prob": 0.1},
        {"respiratory_failure_any": "1"},
        *[{s: 1} for s in late],
    )
    assert [r["LF_no_support"] for r in got[:-2]] == [-1] * 8
    assert [r["LF_no_support"] for r in got[-2:]] == ([0, 0] if version == 3 else [-1, -1])


def test_presence_rules(spark):
    wanted = {
        "counts_narcotic_overdose": 1,
        "counts_hypoxia": 1,
        "counts_decrease_opioids": 1,
        "counts_no_pain_meds": 0,
        "counts_held_opioids": 1,
        "counts_pinpoint_pupils": 1,
    }
    for column, vote in wanted.items():
        got = votes(spark, FINAL, {column: 2}, {column: 0}, {column: None})
        assert [r[f"LF_{column}"] for r in got] == [vote, -1, -1]


def test_versions_list_the_right_rules(spark):
    assert [len(ORDER[v]) for v in (1, 2, 3, 4, FINAL)] == [6, 12, 13, 16, 14]
    assert respiratory_rules_after_review(4).names == respiratory_rules().names
    assert set(DROPPED[2]).isdisjoint(respiratory_rules_after_review(2).names)


def test_rule_set_editing(spark):
    rules = R.RuleSet([R.Rule("a", F.lit(1)), R.Rule("b", F.lit(None).cast("int"))])
    assert rules.without("a").names == ["b"] and rules.names == ["a", "b"]
    assert rules.adding(R.Rule("c", F.lit(0))).names == ["a", "b", "c"]
    with pytest.raises(KeyError):
        rules.without("z")
    with pytest.raises(ValueError):
        rules.adding(R.Rule("a", F.lit(0)))
    assert rules.apply(spark.range(1), ["id"]).first().asDict() == {"id": 0, "a": 1, "b": -1}


def test_strict_runs_count_entries(spark):
    df = spark.createDataFrame([("yes;;yes;;yes;;yes",), ("yes;;yes;;no;;yes;;yes",), ("yes please;;yes;;yes;;yes",)], "v string")
    loose = [r[0] for r in df.select(R.consecutive_text("v", "yes", 3)).collect()]
    strict = [r[0] for r in df.select(R.consecutive_entries("v", "yes", 4)).collect()]
    assert loose == [True, False, True] and strict == [True, False, False]


def test_votes_stay_in_generated_code_with_one_scan(spark, tiny):
    from weaklabel.catalog import views

    plan = views.doc_votes(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    for word in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert word not in plan
    assert plan.count("FileScan parquet") == 2, "documents once, labels once"
