"""Data expectations: each returns the checked frame or raises with what was found."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


class ExpectationFailed(AssertionError):
    pass


def expect_rows(df: DataFrame, expected: int | DataFrame | list[DataFrame]) -> DataFrame:
    """Row count equals a number, another frame's count or the sum of several frames' counts."""
    frames = [expected] if isinstance(expected, DataFrame) else expected
    want = frames if isinstance(frames, int) else sum(f.count() for f in frames)
    got = df.count()
    if got != want:
        raise ExpectationFailed(f"expected {want} rows, found {got}")
    return df


def expect_same_columns(*frames: DataFrame) -> None:
    first = set(frames[0].columns)
    for other in frames[1:]:
        odd = first.symmetric_difference(other.columns)
        if odd:
            raise ExpectationFailed(f"columns differ: {sorted(odd)}")


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key).distinct(), key, "left_semi")


def expect_disjoint(left: DataFrame, right: DataFrame, key: str) -> None:
    if not overlap(left, right, key).isEmpty():
        raise ExpectationFailed(f"both sides share values of {key}")


def expect_positive(df: DataFrame, column: str) -> DataFrame:
    """Every value is > 0, as a logarithm needs; NULL is not."""
    if not df.where(F.col(column).isNull() | (F.col(column) <= 0)).isEmpty():
        raise ExpectationFailed(f"{column} holds values that are missing or not positive")
    return df


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys seen more than once, with the number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def expect_unique(df: DataFrame, *keys: str) -> DataFrame:
    if not duplicate_keys(df, *keys).isEmpty():
        raise ExpectationFailed(f"{keys} is not unique")
    return df


def null_audit(df: DataFrame) -> DataFrame:
    """Missing values per column in one pass, as (column_name, n_missing)."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "n_missing")
