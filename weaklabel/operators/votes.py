"""Vote analytics: summaries, majority vote, buckets, explanations and review sets.

A vote table has one -1/0/1 column per rule next to its key columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from weaklabel import ABSTAIN, CASE, CONTROL


def count_votes(names: Sequence[str], vote: int) -> Column:
    """How many of the rules gave ``vote`` on this row."""
    return reduce(lambda a, b: a + b, [(F.col(n) == vote).cast("int") for n in names])


def n_votes(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [(F.col(n) != ABSTAIN).cast("int") for n in names])


def majority_prob(names: Sequence[str]) -> Column:
    """Probability of case: classes tied for the most votes share it; no vote at all is a tie."""
    case, control = count_votes(names, CASE), count_votes(names, CONTROL)
    return F.when(case > control, 1.0).when(case < control, 0.0).otherwise(0.5)


def with_majority(votes: DataFrame, names: Sequence[str]) -> DataFrame:
    p = majority_prob(names)
    return votes.withColumns({"prob_case": p, "prob_control": 1 - p})


def rule_summary(votes: DataFrame, names: Sequence[str], gold: str | None = None) -> DataFrame:
    """One row per rule: polarity, coverage, overlaps, conflicts and, with gold, accuracy.

    One aggregate over the votes; the result has as many rows as there are rules.
    """
    rows = votes.withColumns({"__case": count_votes(names, CASE), "__control": count_votes(names, CONTROL)})
    total = F.count(F.lit(1))
    stats = []
    for position, name in enumerate(names):
        vote = F.col(name)
        spoke = vote != ABSTAIN
        against = F.when(vote == CASE, F.col("__control")).otherwise(F.col("__case"))
        fields = [
            F.lit(position).alias("position"),
            F.lit(name).alias("rule"),
            F.concat_ws(
                ",",
                F.when(F.max(vote == CONTROL), F.lit("0")),
                F.when(F.max(vote == CASE), F.lit("1")),
            ).alias("polarity"),
            (F.count_if(spoke) / total).alias("coverage"),
            (F.count_if(spoke & (F.col("__case") + F.col("__control") > 1)) / total).alias("overlaps"),
            (F.count_if(spoke & (against > 0)) / total).alias("conflicts"),
        ]
        if gold:
            right = F.count_if(spoke & (vote == F.col(gold)))
            fields += [
                right.alias("correct"),
                F.count_if(spoke & (vote != F.col(gold))).alias("incorrect"),
                F.try_divide(right, F.count_if(spoke)).alias("emp_acc"),
            ]
        stats.append(F.struct(*fields))
    return rows.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def with_weights(summary: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Add each rule's learned weight (one number per rule, so a literal map)."""
    pairs = [F.lit(x) for kv in weights.items() for x in kv]
    return summary.withColumn("learned_weight", F.try_element_at(F.create_map(*pairs), F.col("rule")))


def label_buckets(votes: DataFrame, a: str, b: str) -> DataFrame:
    """Number of rows per pair of votes."""
    return votes.groupBy(a, b).agg(F.count(F.lit(1)).alias("n_rows"))


def bucket_rows(votes: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """Which rows are in which bucket, in long form; a bucket of any size stays distributed."""
    return votes.select(key, F.col(a).alias("vote_a"), F.col(b).alias("vote_b"))


def filter_unlabeled(votes: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows that at least one rule voted on."""
    return votes.where(n_votes(names) > 0)


def explain_votes(votes: DataFrame, names: Sequence[str], key: str, rows: DataFrame | None = None) -> DataFrame:
    """(key, rule, vote) for every vote that is not an abstention, for all or the given rows."""
    wanted = votes.join(rows.select(key).distinct(), key, "left_semi") if rows is not None else votes
    long = wanted.select(key, *names).unpivot([key], list(names), "rule", "vote")
    return long.where(F.col("vote") != ABSTAIN)


def misclassified(df: DataFrame, label: str, prob: str, strict: bool = False) -> DataFrame:
    """Labelled rows the probability disagrees with: cases at or (strict) under 0.5, controls over it."""
    low = F.col(prob) < 0.5 if strict else F.col(prob) <= 0.5
    wrong = ((F.col(label) == "case") & low) | ((F.col(label) == "control") & (F.col(prob) > 0.5))
    return df.where(wrong)


def prediction(prob: str, key: str, tie: str = "abstain", seed: int = 123) -> Column:
    """Class with the higher probability. On a tie: -1, or a fixed coin per row from the key's hash."""
    if tie not in ("abstain", "random"):
        raise ValueError("tie is 'abstain' or 'random'")
    coin = F.when(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), 1, 1) < "8", CONTROL)
    on_tie = F.lit(ABSTAIN) if tie == "abstain" else coin.otherwise(CASE)
    return F.when(F.col(prob) > 0.5, CASE).when(F.col(prob) < 0.5, CONTROL).otherwise(on_tie)
