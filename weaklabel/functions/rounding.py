"""Rounding the way array libraries do it."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_half_even(column: Column | str, digits: int) -> Column:
    """Scale, round half to even, scale back.

    ``bround`` looks at the decimal text instead, so 1.275 gives 1.28 there and 1.27 here.
    """
    c = F.col(column) if isinstance(column, str) else column
    scale = float(10**digits)
    return F.rint(c * scale) / scale
