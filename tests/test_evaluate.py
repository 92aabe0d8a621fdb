import numpy as np
import pytest
from pyspark.sql import functions as F

from weaklabel.operators import evaluate as E


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    y = (rng.random(900) < 0.3).astype(int)
    p = np.round(np.clip(0.3 * y + rng.random(900) * 0.7, 0, 1), 2)
    q = np.where(rng.random(900) < 0.4, 0.0, p)
    rows = [(int(i), int(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(y, p, q, strict=True))]
    df = spark.createDataFrame(rows, "id long, y int, p double, q double").repartition(5).persist()
    return df, y, {"p": p, "q": q}


def brute(y, hit):
    tp, fp = int(((hit == 1) & (y == 1)).sum()), int(((hit == 1) & (y == 0)).sum())
    tn, fn = int(((hit == 0) & (y == 0)).sum()), int(((hit == 0) & (y == 1)).sum())
    return tp, fp, tn, fn


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return float(np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])))


def test_sweep(scored):
    df, y, s = scored
    for r in E.threshold_sweep(df, "y", ["p", "q"], [0.0, 0.5, 0.8, 2.0]).collect():
        tp, fp, tn, fn = brute(y, (s[r["model"]] >= r["threshold"]).astype(int))
        assert (r["tp"], r["fp"], r["tn"], r["fn"]) == (tp, fp, tn, fn)
        assert r["accuracy"] == pytest.approx((tp + tn) / 900)
        assert r["precision"] == pytest.approx(tp / (tp + fp) if tp + fp else 0.0)
        assert r["recall"] == pytest.approx(tp / (tp + fn))
        assert r["specificity"] == pytest.approx(tn / (tn + fp))
        assert r["f1"] == pytest.approx(2 * tp / (2 * tp + fp + fn))
        assert r["auc"] == pytest.approx(brute_auc(y, (s[r["model"]] >= r["threshold"]).astype(float)))


def test_rank_auc_with_ties(scored):
    df, y, s = scored
    got = {r["model"]: r["auc"] for r in E.auc_of_scores(df, "y", ["p", "q"]).collect()}
    for m in s:
        assert got[m] == pytest.approx(brute_auc(y, s[m]))


def test_auc_per_group(scored):
    df, y, s = scored
    got = {r["g"]: r["auc"] for r in E.auc_of_scores(df.withColumn("g", F.col("id") % 2), "y", ["p"], ["g"]).collect()}
    ids = np.arange(900)
    for g in (0, 1):
        assert got[g] == pytest.approx(brute_auc(y[ids % 2 == g], s["p"][ids % 2 == g]))


def test_auc_of_one_class_is_missing(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, p double")
    assert E.auc_of_scores(df, "y", ["p"]).first()["auc"] is None
    row = E.threshold_sweep(df, "y", ["p"], [0.3]).first()
    assert row["auc"] is None and row["specificity"] == 0.0
    empty = E.threshold_sweep(df.where("y = 7"), "y", ["p"], [0.3]).first()
    assert empty["accuracy"] is None and empty["f1"] == 0.0


def test_roc_and_pr_curves(scored):
    df, y, s = scored
    for m in s:
        roc = E.roc_curve(df, "y", [m]).toPandas().sort_values(["fpr", "tpr"])
        levels = np.unique(s[m])[::-1]
        want = [(0.0, 0.0)] + [(np.mean(s[m][y == 0] >= t), np.mean(s[m][y == 1] >= t)) for t in levels]
        np.testing.assert_allclose(roc[["fpr", "tpr"]].to_numpy(), np.array(want))
        assert np.trapezoid(roc["tpr"], roc["fpr"]) == pytest.approx(brute_auc(y, s[m]))
        corners = E.roc_curve(df, "y", [m], drop_collinear=True).toPandas().sort_values(["fpr", "tpr"])
        assert len(corners) <= len(roc)
        assert np.trapezoid(corners["tpr"], corners["fpr"]) == pytest.approx(brute_auc(y, s[m]))
        pr = {r["threshold"]: (r["precision"], r["recall"]) for r in E.pr_curve(df, "y", [m]).collect()}
        assert pr.pop(None) == (1.0, 0.0)
        for t, (precision, recall) in pr.items():
            hit = s[m] >= t
            assert precision == pytest.approx(y[hit].mean()) and recall == pytest.approx(y[hit].sum() / y.sum())


def test_report(scored):
    df, y, s = scored
    rows = {r["class"]: r for r in E.class_report(E.confusion(df, "y", ["p"], [0.5])).collect()}
    tp, fp, tn, fn = brute(y, (s["p"] >= 0.5).astype(int))
    assert rows["1"]["precision"] == pytest.approx(tp / (tp + fp)) and rows["1"]["support"] == tp + fn
    assert rows["0"]["recall"] == pytest.approx(tn / (tn + fp)) and rows["0"]["support"] == tn + fp
    assert rows["accuracy"]["f1"] == pytest.approx((tp + tn) / 900)
    assert rows["macro avg"]["f1"] == pytest.approx((rows["0"]["f1"] + rows["1"]["f1"]) / 2)
    share = (tp + fn) / 900
    assert rows["weighted avg"]["precision"] == pytest.approx(
        rows["1"]["precision"] * share + rows["0"]["precision"] * (1 - share)
    )


@pytest.mark.parametrize("bins", [5, 25])
def test_histogram_matches_numpy(scored, spark, bins):
    df, _y, s = scored
    got = E.histogram(df, "p", bins).orderBy("bin").toPandas()
    counts, edges = np.histogram(s["p"], bins=bins)
    assert got["n_rows"].sum() == 900 and len(got) == bins
    np.testing.assert_allclose(got["bin_start"], edges[:-1])
    # two-digit values may sit on an edge; away from edges the counts are numpy's
    jitter = spark.createDataFrame([(float(v),) for v in np.random.default_rng(0).normal(size=500)], "v double")
    values = np.array([r["v"] for r in jitter.collect()])
    np.testing.assert_array_equal(E.histogram(jitter, "v", bins).orderBy("bin").toPandas()["n_rows"], np.histogram(values, bins)[0])


def test_histogram_of_one_value_and_groups(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0), (None, 1.0), (None, 3.0)], "g string, v double")
    rows = {(r["g"], r["bin"]): r["n_rows"] for r in E.histogram(df, "v", 4, ["g"]).collect()}
    assert rows == {("a", 0): 0, ("a", 1): 0, ("a", 2): 2, ("a", 3): 0, (None, 0): 1, (None, 1): 0, (None, 2): 0, (None, 3): 1}


def test_box_summary(spark):
    rng = np.random.default_rng(2)
    v = np.r_[rng.normal(size=60), [9.0, -8.0]]
    df = spark.createDataFrame([("m", float(x)) for x in v], "g string, v double")
    r = E.box_summary(df, "v", ["g"]).first()
    q1, q2, q3 = np.quantile(v, [0.25, 0.5, 0.75])
    inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
    assert (r["q1"], r["median"], r["q3"]) == pytest.approx((q1, q2, q3))
    assert (r["whisker_low"], r["whisker_high"]) == (inside.min(), inside.max())
    assert (r["n_rows"], r["n_outliers"]) == (62, 62 - len(inside))


def test_dot_plot_and_summaries(spark):
    df = spark.createDataFrame([(i, 0.111 + (i % 2) / 1000, i % 3) for i in range(30)], "id long, p double, y int")
    rows = E.dot_plot_table(df, "p", "y", "id").collect()
    assert sorted(r["counts"] for r in rows) == list(range(30))
    by_count = sorted(rows, key=lambda r: r["counts"])
    assert [r["actual"] for r in by_count] == sorted(r["actual"] for r in by_count)
    folds = spark.createDataFrame([("m", "f1", 1.0), ("m", "f1", 0.5), ("m", "f1", None)], "model string, metric string, value double")
    r = E.fold_summary(folds).first()
    assert (r["mean"], r["sd"], r["n_folds"], r["n_skipped"]) == (0.75, 0.25, 2, 1)


def test_degenerate_fold_has_no_scores(spark):
    rows = [(1, 0, 0), (1, 0, 0), (2, 1, 1), (2, 0, 0), (3, 1, 0), (3, 0, 0)]
    df = spark.createDataFrame(rows, "fold int, y int, p int")
    got = {r["fold"]: r for r in E.fold_metrics(df, ["fold"], "y", "p").collect()}
    assert (got[1]["acc"], got[1]["f1"], got[1]["auc"], got[1]["mse"]) == (None, None, None, 0.0)
    assert (got[2]["acc"], got[2]["f1"], got[2]["auc"], got[2]["mse"]) == (1.0, 1.0, 1.0, 0.0)
    assert got[3]["f1"] is None and got[3]["mse"] == 0.5


def test_review_helpers(spark):
    reviewed = spark.createDataFrame(
        [(1, "g1", 1.0, 1.0), (2, "g1", None, 0.0), (3, "g2", 0.0, 0.5), (4, "g3", None, 0.0)],
        "id int, grid string, outcome double, agreement double",
    )
    scored = spark.createDataFrame([(1, "g1", 0.9, 5.0), (3, "g2", 0.0, 6.0), (9, "g9", 0.1, 7.0)], "id int, grid string, p double, outcome double")
    fix = spark.createDataFrame([(2, 1.0, 0.0)], "id int, outcome double, agreement double")
    final = E.adjudicated_set(reviewed, scored, ["id", "grid"], fix)
    assert {(r["id"], r["outcome"], r["p"], r["outcome_scored"]) for r in final.collect()} == {
        (1, 1.0, 0.9, 5.0),
        (2, 1.0, None, None),
        (3, 0.0, 0.0, 6.0),
    }
    seg = {r["id"]: r["s"] for r in final.select("id", E.disagreement_segment("outcome", "agreement").alias("s")).collect()}
    assert seg == {1: "full-case", 2: "some-case", 3: "some-control"}
    n = E.review_counts(reviewed, scored, final, "id", "grid").first().asDict()
    assert n == {"n_scored": 3, "n_reviewed": 4, "n_excluded": -1, "n_kept": 3, "n_owners": 2}
    owners, cases, clash = E.cohort_export(final, "grid", "outcome")
    assert owners.count() == 3 and {tuple(r) for r in cases.collect()} == {("g1", "g1")}
    assert {tuple(r) for r in clash.collect()} == {("g1", 2)}
    assert E.missed_zero_cases(final, "outcome", ["p"]).first()["n_missed"] == 0
    assert E.base_rate_accuracy(final, "outcome").first()[0] == pytest.approx(1 / 3)
    pivot = {r["outcome"]: (r["n_g1"], r["n_g2"]) for r in E.group_outcome_counts(final, "grid", "outcome", ["g1", "g2"]).collect()}
    assert pivot == {1.0: (2, 0), 0.0: (0, 1)}


def test_auc_of_billions(spark):
    rows = [("m", 0.2, 0, 4_000_000_000), ("m", 0.7, 4_000_000_000, 0), ("t", 0.5, 3_000_000_000, 5_000_000_000)]
    counts = spark.createDataFrame(rows, "model string, score double, n_case long, n_control long")
    assert {r["model"]: r["auc"] for r in E.auc_of_counts(counts, ["model"]).collect()} == {"m": 1.0, "t": 0.5}
