"""Soft targets, binary features and scaling."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from weaklabel.functions.nulls import contains_flag, equals_flag
from weaklabel.operators.cohort import select_matching

# Tasks get this module by value, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Text marks of a drug row that was really given.
GIVEN_MARKS = ("HED", "EPIC IP ADMIN")


def probability_limits(df: DataFrame, prob: str) -> DataFrame:
    """One row (lower_limit, upper_limit): targets for reviewed rows, just outside the observed range."""
    low, high = F.min(prob), F.max(prob)
    return df.agg((0.95 * low).alias("lower_limit"), (0.95 * (1 - high) + high).alias("upper_limit"))


def blended_outcome(df: DataFrame, prob: str, label: str = "label", limits: DataFrame | None = None) -> DataFrame:
    """Add ``outcome``: the model's probability, or the limit of the reviewed class where there is a label.

    ``limits`` lets other rows reuse the training rows' limits; it has one row and joins as a
    scalar subquery.
    """
    edge = limits if limits is not None else probability_limits(df, prob)
    both = edge.select(F.struct("lower_limit", "upper_limit")).scalar()
    out = df.withColumn("__edge", both)
    outcome = (
        F.when(F.col(label).isNull(), F.col(prob))
        .when(F.col(label) == "case", F.col("__edge.upper_limit"))
        .otherwise(F.col("__edge.lower_limit"))
    )
    return out.withColumn("outcome", outcome).drop("__edge")


def fill_outcome_from_label(df: DataFrame, limits: DataFrame, label: str = "label") -> DataFrame:
    """Give rows without an outcome the limit of their reviewed class; others keep theirs."""
    both = limits.select(F.struct("lower_limit", "upper_limit")).scalar()
    out = df.withColumn("__edge", both)
    reviewed = F.when(F.col(label) == "case", F.col("__edge.upper_limit")).otherwise(F.col("__edge.lower_limit"))
    return out.withColumn("outcome", F.coalesce("outcome", reviewed)).drop("__edge")


def hard_target(outcome: str, limit: float = 0.5) -> Column:
    return (F.col(outcome) >= limit).cast("int")


def confidence_weight(prob: str) -> Column:
    """0 at an undecided 0.5, growing to 0.5 at either end."""
    return F.abs(F.col(prob) - 0.5)


def plain_case(pattern: str) -> str:
    """A pattern that begins with (?i) with both cases of each ASCII letter instead: other letters have no second case in it."""
    if not pattern.startswith("(?i)"):
        return pattern
    return re.sub("[A-Za-z]", lambda m: f"[{m[0].upper()}{m[0].lower()}]", pattern.removeprefix("(?i)"))


def count_patterns(docs: DataFrame, text: str, patterns: Mapping[str, str]) -> DataFrame:
    """``docs`` with the number of matches of each pattern in place of ``text``, as ``regexp_count`` has them.

    Patterns are those of classes, repeats and words; Arrow looks for them byte by byte, in a fraction of the time.
    """
    kept = [c for c in docs.columns if c != text]
    plain = {name: plain_case(p) for name, p in patterns.items()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pc.count_substring_regex(batch.column(text), pattern=p).cast(pa.int64()) for p in plain.values()]
            yield pa.record_batch([*(batch.column(c) for c in kept), *found], names=[*kept, *plain])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + [f"`{n}` long" for n in plain]
    return docs.mapInArrow(work, ", ".join(kinds))


def treatment_flag(rows: DataFrame, keys: Sequence[str], text: str, marks: Sequence[str] = GIVEN_MARKS) -> DataFrame:
    """One row per key with 1 if any of its rows' text holds a mark.

    Same flag as searching the joined text, without joining it: a maximum combines before
    the shuffle and a hot key stays one number.
    """
    hit = F.max(contains_flag(text, *marks, null_flag=0))
    return rows.dropna(subset=list(keys)).groupBy(*keys).agg(hit.alias("binary_naloxone_admin"))


def binary_features(
    df: DataFrame,
    texts: Mapping[str, tuple[str, str]],
    equals: Mapping[str, tuple[str, object]],
    null_flag: int = 1,
) -> DataFrame:
    """Add ``binary_*`` columns for all splits at once.

    ``texts``: new name -> (column, needle), case-sensitive; ``equals``: new name -> (column, value).
    """
    made = {n: contains_flag(c, needle, null_flag=null_flag) for n, (c, needle) in texts.items()}
    made |= {n: equals_flag(c, value) for n, (c, value) in equals.items()}
    return df.withColumns(made)


# The clinical binary features.
CLINICAL_TEXTS = {
    "binary_respiratory_failure_any": ("respiratory_failure_any", "1"),
    "binary_eligible_vent": ("eligible_vent", "Yes"),
}
CLINICAL_EQUALS = {
    "binary_gender_female": ("gender", "FEMALE"),
    "binary_cond_resp_failure": ("cond_resp_failure", 1),
    "binary_cond_sepsis": ("cond_sepsis", 1),
    "binary_cond_cva": ("cond_cva", 1),
    "binary_cond_resp_disease": ("cond_resp_disease", 1),
    "binary_cond_cv_disease": ("cond_cv_disease", 1),
}


def feature_columns(df: DataFrame, first: Sequence[str] = ("age_on_admission",)) -> list[str]:
    """``first``, then the ``binary_`` family, then the ``counts_`` family."""
    binary = select_matching(df, "binary_")
    return [*first, *binary, *[c for c in select_matching(df, "counts_") if c not in binary]]


def feature_matrix(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Key columns and features as doubles, missing as 0."""
    return df.select(*keep, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])


def scaling(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: struct (avg, population deviation; 1 for a constant column) per feature."""
    return train.agg(
        *[
            F.struct(
                F.avg(c).alias("mean"),
                F.when(F.stddev_pop(c) == 0, 1.0).otherwise(F.stddev_pop(c)).alias("sd"),
            ).alias(c)
            for c in columns
        ]
    )


def standardize(df: DataFrame, columns: Sequence[str], fitted: DataFrame) -> DataFrame:
    """Apply a fitted scaling as a projection over one scalar subquery."""
    stats = fitted.select(F.struct(*columns)).scalar()
    out = df.withColumn("__scale", stats)
    scaled = {c: (F.col(c) - F.col(f"__scale.`{c}`.mean")) / F.col(f"__scale.`{c}`.sd") for c in columns}
    return out.withColumns(scaled).drop("__scale")


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="error").transform(df)


def log_target(column: str) -> Column:
    """Natural log; ``quality.expect_positive`` is the check that goes before it."""
    return F.ln(column)
