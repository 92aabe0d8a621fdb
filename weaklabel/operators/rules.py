"""Labeling rules as Column expressions, so that voting stays inside generated code."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from weaklabel import ABSTAIN, CASE, CONTROL


@dataclass(frozen=True)
class Rule:
    """A named vote: an expression giving 1 (case), 0 (control) or -1 (abstain)."""

    name: str
    vote: Column

    def column(self) -> Column:
        return F.coalesce(self.vote, F.lit(ABSTAIN)).cast("tinyint").alias(self.name)


class RuleSet:
    """An ordered set of rules; editing gives a new set."""

    def __init__(self, rules: Iterable[Rule]):
        self.rules = list(rules)
        if len(set(self.names)) != len(self.rules):
            raise ValueError("rule names repeat")

    @property
    def names(self) -> list[str]:
        return [r.name for r in self.rules]

    def without(self, *names: str) -> RuleSet:
        unknown = set(names) - set(self.names)
        if unknown:
            raise KeyError(f"no such rule: {sorted(unknown)}")
        return RuleSet(r for r in self.rules if r.name not in names)

    def adding(self, *rules: Rule) -> RuleSet:
        return RuleSet([*self.rules, *rules])

    def apply(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``keep`` columns and one vote column per rule, in one projection."""
        return df.select(*keep, *[r.column() for r in self.rules])


# Rule templates. A NULL comparison is never taken, so missing evidence falls through.


def ladder(*steps: tuple[Column, int], otherwise: int = ABSTAIN) -> Column:
    """First condition that holds decides."""
    vote = F.lit(otherwise)
    for cond, value in reversed(steps):
        vote = F.when(cond, value).otherwise(vote)
    return vote


def present(column: str, vote: int, otherwise: int = ABSTAIN) -> Column:
    """Vote when a count is above zero."""
    return ladder((F.col(column) > 0, vote), otherwise=otherwise)


def at_least(column: str, limit: float, vote: int, below: int = ABSTAIN, missing: int = ABSTAIN) -> Column:
    return ladder((F.col(column) >= limit, vote), (F.col(column) < limit, below), otherwise=missing)


def text_has(column: str, needle: str) -> Column:
    """Case-insensitive substring test."""
    return F.lower(column).contains(needle)


def consecutive_text(column: str, value: str, n: int, sep: str = ";;") -> Column:
    """``n`` neighbouring entries of a joined list read ``value``; plain text match as the lists are text."""
    return F.lower(column).contains(sep.join([value] * n))


def consecutive_entries(column: str, value: str, n: int, sep: str = ";;") -> Column:
    """Strict form: counts whole entries, so ``1.0`` is not ``1`` and ``yes please`` is not ``yes``."""
    hits = F.transform(F.split(F.lower(column), sep), lambda v: v == value)
    run = F.aggregate(
        hits,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")),
        lambda acc, hit: F.struct(
            F.when(hit, acc["now"] + 1).otherwise(0).alias("now"),
            F.greatest(acc["best"], F.when(hit, acc["now"] + 1).otherwise(0)).alias("best"),
        ),
    )
    return run["best"] >= n


def veto(flag: Column | str, vote_if_vetoed: int, inner: Column) -> Column:
    """``inner`` unless the veto flag is set."""
    f = F.col(flag) if isinstance(flag, str) else flag
    return F.when(f, vote_if_vetoed).otherwise(inner)


def evidence_sum(*columns: str) -> Column:
    """Plain sum: one missing part makes the whole sum missing."""
    return reduce(lambda a, b: a + b, [F.col(c) for c in columns])


def all_zero(*columns: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c) == 0 for c in columns])


def rows_with_vote(votes: DataFrame, **wanted: int) -> DataFrame:
    """Rows where each named rule gave the given vote."""
    return votes.where(reduce(lambda a, b: a & b, [F.col(n) == v for n, v in wanted.items()]))


__all__ = [
    "ABSTAIN",
    "CASE",
    "CONTROL",
    "Rule",
    "RuleSet",
    "all_zero",
    "at_least",
    "consecutive_entries",
    "consecutive_text",
    "evidence_sum",
    "ladder",
    "present",
    "rows_with_vote",
    "text_has",
    "veto",
]
