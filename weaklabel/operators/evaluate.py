"""Exact evaluation metrics, curves and tables as aggregates.

Input is one row per unit with a 0/1 outcome and one score column per model.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from weaklabel.functions.ranking import exact_quantiles, hash_rank, join_null_safe, running_totals
from weaklabel.functions.rounding import round_half_even


def confusion(df: DataFrame, outcome: str, scores: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """(model, threshold, tp, fp, tn, fn) for all pairs from one aggregate over the rows.

    Rows without an outcome or without the score are left out of that model's counts.
    """
    y = F.col(outcome)
    cells = []
    for name in scores:
        for t in thresholds:
            hit = F.col(name) >= t
            cells.append(
                F.struct(
                    F.lit(name).alias("model"),
                    F.lit(float(t)).alias("threshold"),
                    F.count_if(hit & (y == 1)).alias("tp"),
                    F.count_if(hit & (y == 0)).alias("fp"),
                    F.count_if(~hit & (y == 0)).alias("tn"),
                    F.count_if(~hit & (y == 1)).alias("fn"),
                )
            )
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def confusion_of_prediction(df: DataFrame, outcome: str, predicted: str) -> DataFrame:
    """(tp, fp, tn, fn) of a 0/1 prediction column."""
    y, p = F.col(outcome), F.col(predicted)
    return df.agg(
        F.count_if((p == 1) & (y == 1)).alias("tp"),
        F.count_if((p == 1) & (y == 0)).alias("fp"),
        F.count_if((p == 0) & (y == 0)).alias("tn"),
        F.count_if((p == 0) & (y == 1)).alias("fn"),
    )


def _ratio(top: Column, bottom: Column, undefined) -> Column:
    return F.when(bottom == 0, F.lit(undefined).cast("double")).otherwise(F.try_divide(top, bottom))


def metrics(table: DataFrame) -> DataFrame:
    """Add accuracy, precision, recall, specificity, f1 and the AUC of the 0/1 prediction.

    Precision, recall and F1 are 0 where undefined; AUC is NULL with one class only.
    """
    tp, fp, tn, fn = F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn")
    recall, specificity = _ratio(tp, tp + fn, 0.0), _ratio(tn, tn + fp, 0.0)
    both = (tp + fn > 0) & (tn + fp > 0)
    return table.withColumns(
        {
            "accuracy": _ratio(tp + tn, tp + fp + tn + fn, None),
            "precision": _ratio(tp, tp + fp, 0.0),
            "recall": recall,
            "specificity": specificity,
            "f1": _ratio(2 * tp, 2 * tp + fp + fn, 0.0),
            "auc": F.when(both, (recall + specificity) / 2),
        }
    )


def threshold_sweep(
    df: DataFrame, outcome: str, scores: Sequence[str], thresholds: Sequence[float] = (0.5, 0.7, 0.8, 0.9)
) -> DataFrame:
    return metrics(confusion(df, outcome, scores, thresholds))


def two_score_prediction(limits: Mapping[str, float]) -> Column:
    """1 when every score reaches its own limit."""
    cond = F.lit(True)
    for name, limit in limits.items():
        cond = cond & (F.col(name) >= limit)
    return F.when(cond, 1).otherwise(0)


def class_report(table: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Per class, plus accuracy, macro and weighted averages, as rows of
    (class, precision, recall, f1, support) from confusion counts."""
    tp, fp, tn, fn = F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn")
    total = tp + fp + tn + fn
    part = {
        "0": (_ratio(tn, tn + fn, 0.0), _ratio(tn, tn + fp, 0.0), _ratio(2 * tn, 2 * tn + fn + fp, 0.0), tn + fp),
        "1": (_ratio(tp, tp + fp, 0.0), _ratio(tp, tp + fn, 0.0), _ratio(2 * tp, 2 * tp + fp + fn, 0.0), tp + fn),
    }

    def row(name: str, p: Column, r: Column, f: Column, n: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"), n.alias("support")
        )

    right = _ratio(tp + tn, total, None)
    mean = [(a + b) / 2 for a, b in zip(part["0"][:3], part["1"][:3], strict=True)]
    weighted = [
        _ratio(a * part["0"][3] + b * part["1"][3], total, None) for a, b in zip(part["0"][:3], part["1"][:3], strict=True)
    ]
    rows = [row(c, *v) for c, v in part.items()]
    rows += [
        row("accuracy", right, right, right, total),
        row("macro avg", *mean, total),
        row("weighted avg", *weighted, total),
    ]
    return table.select(*keep, F.inline(F.array(*rows)))


def score_counts(df: DataFrame, outcome: str, scores: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """(``within``, model, score, n_case, n_control) per distinct score; rows combine before the shuffle."""
    known = df.where(F.col(outcome).isNotNull()).select(
        *within, F.col(outcome).alias("__y"), *[F.col(s).cast("double") for s in scores]
    )
    long = known.unpivot([*within, "__y"], list(scores), "model", "score").where(F.col("score").isNotNull())
    return long.groupBy(*within, "model", "score").agg(
        F.count_if(F.col("__y") == 1).alias("n_case"), F.count_if(F.col("__y") == 0).alias("n_control")
    )


def auc_of_scores(df: DataFrame, outcome: str, scores: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Rank AUC per (``within``, model) with ties at one half; NULL when a class is missing."""
    return auc_of_counts(score_counts(df, outcome, scores, within), [*within, "model"])


def auc_of_counts(counts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Rank AUC per group from (``groups``, score, n_case, n_control), one row per score."""
    ranked = running_totals(counts, "score", ["n_control"], groups)
    below = F.col("cum_n_control") - F.col("n_control")
    # doubles before any product: billions of cases times billions of controls overflow a long
    n_case = F.col("n_case").cast("double")
    wins = F.sum(n_case * (below + F.col("n_control") / 2))
    pairs = F.sum(n_case) * F.max("all_n_control")
    return ranked.groupBy(*groups).agg(F.try_divide(wins, pairs).alias("auc"))


def roc_curve(df: DataFrame, outcome: str, scores: Sequence[str], drop_collinear: bool = False) -> DataFrame:
    """(model, threshold, fpr, tpr), one row per distinct score, plus the (0, 0) start with a NULL threshold.

    ``drop_collinear`` leaves out points whose two neighbours move the same way, as these lie
    on a straight line.
    """
    points = running_totals(score_counts(df, outcome, scores), "score", ["n_case", "n_control"], ["model"], descending=True)
    if drop_collinear:
        points = _corners(points)
    curve = points.select(
        "model",
        F.col("score").alias("threshold"),
        _ratio(F.col("cum_n_control"), F.col("all_n_control"), None).alias("fpr"),
        _ratio(F.col("cum_n_case"), F.col("all_n_case"), None).alias("tpr"),
    )
    models = df.sparkSession.createDataFrame([(s,) for s in scores], "model string")
    start = models.select(
        "model", F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return curve.unionByName(start)


def _corners(points: DataFrame) -> DataFrame:
    """Keep the ends and each point where the step onward differs from the step that led to it.

    The step that leads to a point is its own counts; the next point's counts come from a
    ranked neighbour join, so no window has to hold a whole model.
    """
    w_rank = running_totals(points.withColumn("one", F.lit(1)), "score", ["one"], ["model"], descending=True)
    here = w_rank.withColumnRenamed("cum_one", "pos").drop("all_one", "one")
    after = here.select("model", (F.col("pos") - 1).alias("pos"), F.col("n_case").alias("__nc"), F.col("n_control").alias("__nk"))
    joined = here.join(after, ["model", "pos"], "left")
    ends = (F.col("pos") == 1) | F.col("__nc").isNull()
    turns = (F.col("__nc") != F.col("n_case")) | (F.col("__nk") != F.col("n_control"))
    return joined.where(ends | turns).drop("__nc", "__nk", "pos")


def pr_curve(df: DataFrame, outcome: str, scores: Sequence[str]) -> DataFrame:
    """(model, threshold, precision, recall) per distinct score, ending at (1, 0) with a NULL threshold."""
    points = running_totals(score_counts(df, outcome, scores), "score", ["n_case", "n_control"], ["model"], descending=True)
    curve = points.select(
        "model",
        F.col("score").alias("threshold"),
        _ratio(F.col("cum_n_case"), F.col("cum_n_case") + F.col("cum_n_control"), 0.0).alias("precision"),
        _ratio(F.col("cum_n_case"), F.col("all_n_case"), None).alias("recall"),
    )
    models = df.sparkSession.createDataFrame([(s,) for s in scores], "model string")
    end = models.select(
        "model", F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return curve.unionByName(end)


def histogram(df: DataFrame, value: str, bins: int, within: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over each group's own range, right edge in the last bin, empty bins kept.

    Result: (``within``, bin 0-based, bin_start, n_rows). Rows combine to ``bins`` counts per
    group before they move.
    """
    within = list(within)
    rows = df.where(F.col(value).isNotNull()).select(*within, F.col(value).cast("double").alias("__v"))
    edges = rows.groupBy(*within).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    if within:
        renamed = edges.withColumnsRenamed({c: f"__r_{c}" for c in within})
        same = F.lit(True)
        for c in within:
            same = same & rows[c].eqNullSafe(renamed[f"__r_{c}"])
        placed = rows.join(renamed, same).drop(*[f"__r_{c}" for c in within])
    else:
        placed = rows.withColumn("__e", edges.select(F.struct("__lo", "__hi")).scalar()).select("*", "__e.*").drop("__e")
    # a single value gets a range of one around it
    low = F.when(F.col("__hi") == F.col("__lo"), F.col("__lo") - 0.5).otherwise(F.col("__lo"))
    width = F.when(F.col("__hi") == F.col("__lo"), F.lit(1.0)).otherwise(F.col("__hi") - F.col("__lo"))
    slot = F.least(F.floor((F.col("__v") - low) / width * bins), F.lit(bins - 1)).cast("int")
    counts = placed.groupBy(*within, "__lo", "__hi", slot.alias("bin")).agg(F.count(F.lit(1)).alias("__n"))
    empty = edges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).withColumn("__n", F.lit(0).cast("bigint"))
    both = counts.unionByName(empty).groupBy(*within, "bin", "__lo", "__hi").agg(F.sum("__n").alias("n_rows"))
    return both.select(*within, "bin", (low + F.col("bin") * width / bins).alias("bin_start"), "n_rows")


def box_summary(df: DataFrame, value: str, within: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers (furthest values within 1.5 box heights) and outlier count per group."""
    within = list(within)
    rows = df.where(F.col(value).isNotNull())
    quartiles = exact_quantiles(rows, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, within)
    counts = rows.groupBy(*within, value).agg(F.count(F.lit(1)).alias("__n"))
    joined = join_null_safe(counts, quartiles.drop("n"), within)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col(value) >= F.col("q1") - reach) & (F.col(value) <= F.col("q3") + reach)
    return joined.groupBy(*within, "q1", "median", "q3").agg(
        F.sum("__n").alias("n_rows"),
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.sum(F.when(~inside, F.col("__n")).otherwise(0)).alias("n_outliers"),
    )


def dot_plot_table(df: DataFrame, prob: str, actual: str, key: str, seed: int = 123) -> DataFrame:
    """(key, predicted, actual, counts): half-even rounded probability and the running number
    of rows with it, lower classes first. A hot probability is ranked in hash buckets."""
    rows = df.select(key, round_half_even(prob, 2).alias("predicted"), F.col(actual).alias("actual"))
    ranked = hash_rank(rows, key, seed, within=["predicted"], lead=["actual"], rank="counts")
    return ranked.withColumn("counts", F.col("counts") - 1)


def group_outcome_counts(df: DataFrame, group: str, outcome: str, groups: Sequence[str]) -> DataFrame:
    """Outcome value per row, one count column per group value."""
    counted = df.groupBy(outcome).pivot(group, list(groups)).agg(F.count(F.lit(1)))
    return counted.select(outcome, *[F.coalesce(F.col(g), F.lit(0)).alias(f"n_{g}") for g in groups])


def base_rate_accuracy(df: DataFrame, outcome: str) -> DataFrame:
    """Accuracy of always saying control."""
    return df.agg((1 - F.avg(F.col(outcome).cast("double"))).alias("base_rate_accuracy"))


def missed_zero_cases(df: DataFrame, outcome: str, scores: Sequence[str]) -> DataFrame:
    """Cases each model gave a probability of exactly 0."""
    cells = [
        F.struct(
            F.lit(s).alias("model"), F.count_if((F.col(s) == 0) & (F.col(outcome) == 1)).alias("n_missed")
        )
        for s in scores
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def disagreement_segment(outcome: str, agreement: str) -> Column:
    """full/some agreement x case/control, NULL where review is incomplete."""
    kind = F.when(F.col(outcome) == 1, "case").when(F.col(outcome) == 0, "control")
    how = F.when(F.col(agreement) == 1, "full").when(F.col(agreement) < 1, "some")
    return F.concat(how, F.lit("-"), kind)


def adjudicated_set(reviewed: DataFrame, scored: DataFrame, keys: Sequence[str], overrides: DataFrame | None = None) -> DataFrame:
    """Reviewed rows with their scores; overrides replace outcome and agreement; rows that stay
    without an outcome go away. Score columns that share a name with a review column get ``_scored``."""
    from weaklabel.operators.cohort import override_cells

    keys = list(keys)
    shared = [c for c in scored.columns if c in reviewed.columns and c not in keys]
    joined = reviewed.join(scored.withColumnsRenamed({c: f"{c}_scored" for c in shared}), keys, "left")
    if overrides is not None:
        joined = override_cells(joined, overrides, keys[0])
    return joined.where(F.col("outcome").isNotNull())


def review_counts(reviewed: DataFrame, scored: DataFrame, final: DataFrame, key: str, owner: str) -> DataFrame:
    """One row: reviewed, scored, not reviewed, kept rows and kept owners."""
    n = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return final.agg(F.count(F.lit(1)).alias("n_kept"), F.countDistinct(owner).alias("n_owners")).select(
        n(scored).alias("n_scored"), n(reviewed).alias("n_reviewed"), (n(scored) - n(reviewed)).alias("n_excluded"), "*"
    )


def cohort_export(df: DataFrame, owner: str, outcome: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all owner ids, case ids written twice, owners with several rows of whom one is a case).

    The third table must be empty before the first two may be used.
    """
    owners = df.select(owner)
    cases = df.where(F.col(outcome) == 1).select(owner, F.col(owner).alias(f"{owner}_repeated"))
    per_owner = df.groupBy(owner).agg(F.count(F.lit(1)).alias("n_rows"), F.max(outcome).alias("any_case"))
    clash = per_owner.where((F.col("n_rows") > 1) & (F.col("any_case") == 1)).select(owner, "n_rows")
    return owners, cases, clash


def fold_summary(results: DataFrame) -> DataFrame:
    """Mean and population deviation per (model, metric); folds without a value are counted apart."""
    return results.groupBy("model", "metric").agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("sd"),
        F.count("value").alias("n_folds"),
        F.count_if(F.col("value").isNull()).alias("n_skipped"),
    )


def fold_metrics(df: DataFrame, fold: Sequence[str], outcome: str, predicted: str) -> DataFrame:
    """Per fold: accuracy, F1, AUC of the 0/1 prediction (NULL unless both the truth and the
    prediction have both classes) and mean squared error."""
    y, p = F.col(outcome), F.col(predicted)
    cells = df.groupBy(*fold).agg(
        F.count_if((p == 1) & (y == 1)).alias("tp"),
        F.count_if((p == 1) & (y == 0)).alias("fp"),
        F.count_if((p == 0) & (y == 0)).alias("tn"),
        F.count_if((p == 0) & (y == 1)).alias("fn"),
        F.avg(F.pow(y - p, F.lit(2))).alias("mse"),
    )
    usable = (F.col("tp") + F.col("fn") > 0) & (F.col("tn") + F.col("fp") > 0)
    usable = usable & (F.col("tp") + F.col("fp") > 0) & (F.col("tn") + F.col("fn") > 0)
    full = metrics(cells)
    return full.select(
        *fold,
        F.when(usable, F.col("accuracy")).alias("acc"),
        F.when(usable, F.col("f1")).alias("f1"),
        F.when(usable, F.col("auc")).alias("auc"),
        "mse",
    )


def class_of_regression(predicted: str, outcome: str, log_scale: bool) -> tuple[Column, Column]:
    """(prediction, truth) as 0/1: exponentiate both when they are logs, then cut at 0.5."""
    p, y = F.col(predicted), F.col(outcome)
    if log_scale:
        p, y = F.exp(p), F.exp(y)
    return (p >= 0.5).cast("int"), (y >= 0.5).cast("int")


