"""Missing-value rules: one place where NaN, NULL and the text forms of both meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType


def nan_to_null(df: DataFrame, *columns: str) -> DataFrame:
    """Turn NaN into NULL in the named (default: all) floating columns.

    Spark sorts NaN above every number, so ``NaN >= 0.8`` is true; rules and
    counts are only right after this step.
    """
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    wanted = set(columns or floating)
    changes = {c: F.when(~F.isnan(c), F.col(c)) for c in floating if c in wanted}
    return df.withColumns(changes) if changes else df


def as_text(column: Column | str, missing: str = "nan") -> Column:
    """Text of a value with a visible marker for NULL, so that joined lists keep their length."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit(missing))


def contains_flag(column: Column | str, *needles: str, null_flag: int = 1) -> Column:
    """1 when the text holds any needle. A missing text counts as ``null_flag``."""
    c = F.col(column) if isinstance(column, str) else column
    hit = F.lit(False)
    for needle in needles:
        hit = hit | c.contains(needle)
    return F.when(c.isNull(), F.lit(null_flag)).when(hit, 1).otherwise(0)


def equals_flag(column: str, value) -> Column:
    """1 when equal, 0 when different or missing."""
    return F.when(F.col(column) == F.lit(value), 1).otherwise(0)


def encode_label(column: str = "label", positive: str = "case") -> Column:
    """Gold label as 1/0; a missing label counts as 0."""
    return F.when(F.col(column) == positive, 1).otherwise(0)
