"""Label model: learn each rule's accuracy without gold labels, then score rows.

The only pass over the data counts pairs of votes. The pair table has at most
``2m * (2m + 1) / 2`` rows for ``m`` rules, so it is the one thing the driver sees;
scoring is a projection with the fitted numbers as literals.
"""

from __future__ import annotations

import itertools
import math
import sys
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from weaklabel import ABSTAIN, CASE, CONTROL

# Tasks get this module by value, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def vote_patterns(votes: DataFrame, names: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Distinct vote vectors with their row counts; combined before the shuffle."""
    return votes.groupBy(*names, *extra).agg(F.count(F.lit(1)).alias("n_rows"))


def _held_pairs(patterns: DataFrame, names: Sequence[str], every_row: bool) -> DataFrame:
    """Pairs of votes held by the same row; ``every_row`` adds item -1, which all rows hold."""
    items = [F.when(F.col(n) != ABSTAIN, F.lit(2 * r) + F.col(n).cast("int")) for r, n in enumerate(names)]
    if every_row:
        items = [F.lit(-1), *items]
    held = patterns.select(F.array_compact(F.array(*items)).alias("items"), "n_rows")
    # a plain explode makes Spark test the array for emptiness below the grouping, which would
    # work out every vote a second time
    first = held.select(F.explode_outer("items").alias("i"), "items", "n_rows")
    later = F.filter("items", lambda x: (x >= F.col("i")) & ((F.col("i") >= 0) | (x < 0)))
    both = first.select("i", F.explode_outer(later).alias("j"), "n_rows").where(F.col("j").isNotNull())
    return both.groupBy("i", "j").agg(F.sum("n_rows").alias("n_rows"))


def vote_pairs(patterns: DataFrame, names: Sequence[str]) -> DataFrame:
    """(i, j, n_rows): how many rows hold both vote i and vote j, i <= j.

    Vote ``2 * r + y`` is rule r voting y. Pairs are of rules within a row, never of rows.
    """
    return _held_pairs(patterns, names, every_row=False)


def overlap_matrix(votes: DataFrame, names: Sequence[str], compress: bool = True) -> tuple[np.ndarray, int]:
    """(O, rows): share of rows holding both votes, as a small symmetric matrix.

    ``compress`` counts distinct vote vectors first, which pays off for sparse rules.
    """
    counted = vote_patterns(votes, names) if compress else votes.select(*names, F.lit(1).cast("bigint").alias("n_rows"))
    found = {(r["i"], r["j"]): r["n_rows"] for r in _held_pairs(counted, names, every_row=True).collect()}
    total = found.pop((-1, -1), 0)
    if not total:
        raise ValueError("no rows to learn from")
    matrix = np.zeros((2 * len(names), 2 * len(names)))
    for (i, j), n in found.items():
        matrix[i, j] = matrix[j, i] = n / total
    return matrix, int(total)


def class_balance_of(df: DataFrame, gold: str, smoothing: float = 0.5) -> tuple[float, float]:
    """(control, case) shares of a 0/1 gold column, with ``smoothing`` pseudo-rows of each class.

    A small review set may hold no case at all, and no share may be 0.
    """
    y = F.col(gold).cast("double")
    n, n_case = df.agg(F.count(y), F.coalesce(F.sum(y), F.lit(0.0))).first()
    if not n:
        raise ValueError(f"no row has a value in {gold}: the class balance can't be learned from it")
    smooth = smoothing if n_case in (0, n) else 0.0
    p = (n_case + smooth) / (n + 2 * smooth)
    return 1 - p, p


def _rate(schedule: str, lr: float, epoch: int, n_epochs: int) -> float:
    if schedule == "constant":
        return lr
    if schedule == "linear":
        return lr * (1 - epoch / n_epochs)
    if schedule == "exponential":
        return lr * 0.01 ** (epoch / n_epochs)
    if schedule == "step":
        return lr * 0.5 ** (epoch // max(1, n_epochs // 4))
    raise ValueError(f"unknown schedule {schedule!r}")


def solve(
    overlaps: np.ndarray,
    prior: Sequence[float],
    n_epochs: int = 2000,
    lr: float = 0.01,
    lr_scheduler: str = "step",
    seed: int | None = None,
    prec_init: float = 0.7,
    mu_eps: float = 1e-4,
) -> tuple[np.ndarray, float]:
    """Fit mu[vote, y] = P(vote | y) to the overlaps by full-batch Adamax.

    Loss: squared error of ``mu diag(p) mu'`` on entries of different rules, plus squared
    error of the votes' marginals. ``seed`` scales the start; without it the start is fixed.
    """
    size = overlaps.shape[0]
    p = np.asarray(prior, dtype=float)
    block = np.arange(size) // 2
    apart = (block[:, None] != block[None, :]).astype(float)
    rate = np.diag(overlaps)
    # each rule starts out right with probability prec_init in both classes; a start from
    # rate / prior saturates for a rare class and then hardly moves
    coverage = np.repeat(rate.reshape(-1, 2).sum(axis=1), 2)
    start = np.empty((size, 2))
    for y in (CONTROL, CASE):
        agrees = np.arange(size) % 2 == y
        start[:, y] = np.where(rate > 0, coverage * np.where(agrees, prec_init, 1 - prec_init), 0.0)
    if seed is not None:
        start = start * np.random.default_rng(seed).uniform(0.5, 1.0, start.shape)
    mu, moment, bound = start.copy(), np.zeros_like(start), np.zeros_like(start)
    best, best_loss = mu, math.inf
    for epoch in range(n_epochs):
        gap = apart * (mu @ np.diag(p) @ mu.T - overlaps)
        marginal = mu @ p - rate
        loss = float((gap**2).sum() + (marginal**2).sum())
        if loss < best_loss:
            best, best_loss = mu.copy(), loss
        grad = 4 * gap @ mu * p + 2 * np.outer(marginal, p)
        moment = 0.9 * moment + 0.1 * grad
        bound = np.maximum(0.999 * bound, np.abs(grad) + 1e-8)
        mu = mu - _rate(lr_scheduler, lr, epoch, n_epochs) / (1 - 0.9 ** (epoch + 1)) * moment / bound
        mu = np.clip(mu, 0, 1)
    return np.clip(best, mu_eps, 1 - mu_eps), best_loss


def accuracies_by_triples(pairs: DataFrame, names: Sequence[str]) -> DataFrame:
    """(rule, n_triples, learned_weight): each rule's accuracy in closed form from agreement rates, without gold labels.

    If rules err independently given the class, twice the agreement rate less one of two rules is the product of
    their own such numbers a, so a^2 of one rule is the product of its numbers with two others over the number of
    those two. A rule's a is the mean over all pairs of others that the three ever vote with; rules are taken to be
    better than chance; the accuracy is (1 + a) / 2. A rule that is in no triple has none. ``pairs`` are those of
    ``vote_pairs``, so all here is on rules x rules rows.
    """
    rule = F.create_map(*[F.lit(v) for r, n in enumerate(names) for v in (r, n)])
    split = lambda c: (F.floor(F.col(c) / 2).cast("int"), F.col(c) % 2)
    (a, va), (b, vb) = split("i"), split("j")
    counts = pairs.select(a.alias("a"), b.alias("b"), (va == vb).alias("same"), "n_rows").where("a <> b")
    both = counts.groupBy("a", "b").agg((2 * F.sum(F.when(F.col("same"), F.col("n_rows")).otherwise(0)) / F.sum("n_rows") - 1).alias("e"))
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "e"))
    left, right, far = both, both.select("a", F.col("b").alias("c"), F.col("e").alias("f")), both.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("e").alias("g"))
    triples = left.join(right, "a").where("b < c").join(far, ["b", "c"]).where("g <> 0")
    square = F.abs(F.col("e") * F.col("f") / F.col("g"))
    found = triples.groupBy("a").agg(F.count("*").alias("n_triples"), F.avg(F.least(F.sqrt(square), F.lit(1.0))).alias("m"))
    every = pairs.sparkSession.range(len(names)).select(F.col("id").cast("int").alias("a"))
    known = every.join(found, "a", "left")
    return known.select(rule[F.col("a")].alias("rule"), F.coalesce("n_triples", F.lit(0)).cast("long").alias("n_triples"), ((1 + F.col("m")) / 2).alias("learned_weight"))


def weights_of(mu: np.ndarray, prior: Sequence[float], overlaps: np.ndarray) -> list[float]:
    """Estimated accuracy per rule: share of its votes that agree with the class."""
    out = []
    for r in range(mu.shape[0] // 2):
        right = sum(mu[2 * r + y, y] * prior[y] for y in (CONTROL, CASE))
        coverage = overlaps[2 * r, 2 * r] + overlaps[2 * r + 1, 2 * r + 1]
        out.append(float(np.clip(right / coverage, 1e-6, 1.0)) if coverage > 0 else float("nan"))
    return out


@dataclass
class LabelModel:
    """Fitted rule accuracies; ``mu[2 * r + vote][y]`` is P(rule r votes ``vote`` | class y)."""

    names: list[str]
    prior: tuple[float, float]
    mu: np.ndarray
    overlaps: np.ndarray | None = None
    loss: float = float("nan")
    spread: float = 0.0
    notes: dict = field(default_factory=dict)

    @classmethod
    def fit(
        cls,
        votes: DataFrame,
        names: Sequence[str],
        class_balance: Sequence[float] | None = None,
        gold: tuple[DataFrame, str] | None = None,
        starts: Iterable[int | None] = (None,),
        **options,
    ) -> LabelModel:
        """``class_balance`` (control, case) wins over ``gold`` (frame, 0/1 column); without
        both the balance is even. Of several starts the one with the least loss stays, and
        ``spread`` says how far the rare class's column moved between them."""
        prior = tuple(class_balance) if class_balance else class_balance_of(*gold) if gold else (0.5, 0.5)
        overlaps, _rows = overlap_matrix(votes, names)
        return cls.from_overlaps(overlaps, names, prior, starts, **options)

    @classmethod
    def from_overlaps(cls, overlaps, names, prior, starts: Iterable[int | None] = (None,), **options) -> LabelModel:
        fits = [solve(overlaps, prior, seed=s, **options) for s in starts]
        mu, loss = min(fits, key=lambda f: f[1])
        rare = int(np.argmin(prior))
        spread = max(float(np.abs(m[:, rare] - mu[:, rare]).max()) for m, _ in fits)
        model = cls(list(names), tuple(prior), mu, overlaps, loss, spread)
        accuracy = [w for w in model.weights().values() if not math.isnan(w)]
        if accuracy and np.mean(np.asarray(accuracy) < 0.5) > 0.5 and abs(prior[0] - prior[1]) < 1e-9:
            # the factorisation is blind to swapping the classes when they are equally common
            model.mu = mu[:, ::-1].copy()
        return model

    def weights(self) -> dict[str, float]:
        return dict(zip(self.names, weights_of(self.mu, self.prior, self.overlaps), strict=True))

    def log_odds(self) -> Column:
        """Log odds of case from the votes that were cast; an abstention adds nothing."""
        total = F.lit(math.log(self.prior[CASE] / self.prior[CONTROL]))
        for r, name in enumerate(self.names):
            step = {v: math.log(self.mu[2 * r + v, CASE] / self.mu[2 * r + v, CONTROL]) for v in (CONTROL, CASE)}
            total = total + F.when(F.col(name) == CASE, step[CASE]).when(F.col(name) == CONTROL, step[CONTROL]).otherwise(0.0)
        return total

    def prob_case(self) -> Column:
        return 1 / (1 + F.exp(-self.log_odds()))

    def score(self, votes: DataFrame, column: str = "prob_case") -> DataFrame:
        return votes.withColumn(column, self.prob_case())

    def parameters(self, spark) -> DataFrame:
        """(rule, vote, p_given_control, p_given_case) as a table, to save and to review."""
        rows = [
            (name, v, float(self.mu[2 * r + v, CONTROL]), float(self.mu[2 * r + v, CASE]))
            for r, name in enumerate(self.names)
            for v in (CONTROL, CASE)
        ]
        return spark.createDataFrame(rows, "rule string, vote int, p_given_control double, p_given_case double")

    @classmethod
    def from_parameters(cls, table: DataFrame, prior: Sequence[float], names: Sequence[str]) -> LabelModel:
        """Rebuild from a saved parameter table (two rows per rule)."""
        mu = np.zeros((2 * len(names), 2))
        for r in table.where(F.col("rule").isin(list(names))).collect():
            mu[2 * list(names).index(r["rule"]) + r["vote"]] = [r["p_given_control"], r["p_given_case"]]
        return cls(list(names), tuple(prior), mu)


def accuracy(df: DataFrame, prob: str, gold: str, key: str, tie: str = "abstain") -> DataFrame:
    """Share of right predictions; ties are left out unless ``tie='random'`` breaks them."""
    from weaklabel.operators.votes import prediction

    rows = df.select(F.col(gold).alias("y"), prediction(prob, key, tie).alias("pred")).where(F.col("pred") != ABSTAIN)
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg((F.col("pred") == F.col("y")).cast("double")).alias("accuracy"),
    )


def tune(
    train: DataFrame,
    dev: DataFrame,
    names: Sequence[str],
    gold: str,
    class_balance: Sequence[float] | None = None,
    n_epochs: Sequence[int] = (2000, 4000),
    lr: Sequence[float] = (0.001, 0.005, 0.01),
    lr_scheduler: Sequence[str] = ("step", "exponential", "linear"),
    seed: Sequence[int] = (123, 456, 987),
) -> DataFrame:
    """Grid over solver settings: learned weight per rule and accuracy on ``dev``, wide form.

    All fits share one small overlap matrix and run as Spark tasks; dev accuracy for the
    whole grid is one aggregate over dev's vote patterns.
    """
    spark = train.sparkSession
    names = list(names)
    prior = tuple(class_balance) if class_balance else class_balance_of(dev, gold)
    overlaps, _rows = overlap_matrix(train, names)
    grid = [
        (i, *c) for i, c in enumerate(itertools.product([int(e) for e in n_epochs], map(float, lr), lr_scheduler, map(int, seed)))
    ]
    settings = "config int, n_epochs int, lr double, lr_scheduler string, seed int"
    configs = spark.createDataFrame(grid, settings).repartition(
        min(len(grid), spark.sparkContext.defaultParallelism), "config"
    )

    def fit_all(batches):
        for batch in batches:
            rows = []
            for c in batch.itertuples(index=False):
                mu, loss = solve(overlaps, prior, int(c.n_epochs), float(c.lr), c.lr_scheduler, int(c.seed))
                rows.append((*c, mu.ravel().tolist(), weights_of(mu, prior, overlaps), loss))
            yield pd.DataFrame(rows, columns=[*batch.columns, "mu", "weights", "loss"])

    fitted = configs.mapInPandas(fit_all, f"{settings}, mu array<double>, weights array<double>, loss double").collect()
    known = vote_patterns(dev.where(F.col(gold).isNotNull()), names, [gold])
    sums = []
    for r in fitted:
        model = LabelModel(names, prior, np.asarray(r["mu"]).reshape(-1, 2))
        odds = model.log_odds()
        right = ((odds > 0) & (F.col(gold) == CASE)) | ((odds < 0) & (F.col(gold) == CONTROL))
        sums.append(
            F.try_divide(
                F.sum(F.when(right, F.col("n_rows")).otherwise(0)), F.sum(F.when(odds != 0, F.col("n_rows")))
            ).alias(f"a{r['config']}")
        )
    scores = known.agg(*sums).first().asDict()
    wide = [
        (r["n_epochs"], r["lr"], r["lr_scheduler"], r["seed"], *[None if w != w else w for w in r["weights"]], scores[f"a{r['config']}"])
        for r in sorted(fitted, key=lambda r: r["config"])
    ]
    schema = "n_epochs int, lr double, lr_scheduler string, seed int, " + ", ".join(f"`{n}` double" for n in names)
    return spark.createDataFrame(wide, f"{schema}, accuracy double")
