"""Exact ranks, running totals and quantiles without a single-task window.

A plain ``row_number`` over a table or over one hot group sorts everything in
one task. Here rows are first put into ordered buckets, each bucket is ranked
on its own, and the bucket totals (a small table) give the offsets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows that one bucket is meant to hold; the number of buckets follows from the counted rows.
BUCKET_ROWS = 1_000_000


def hash_of(key: str | Sequence[str], seed: int) -> Column:
    """md5 of ``key:seed``: a shuffle order that does not depend on partitioning."""
    keys = [key] if isinstance(key, str) else list(key)
    parts = [F.col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *parts, F.lit(str(seed))))


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join on columns that may be NULL; the right copies of the keys go away."""
    if not on:
        raise ValueError("no join columns")
    renamed = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    cond = None
    for c in on:
        term = left[c].eqNullSafe(renamed[f"__r_{c}"])
        cond = term if cond is None else cond & term
    return left.join(renamed, cond, "left").drop(*[f"__r_{c}" for c in on])


def hash_rank(
    df: DataFrame,
    key: str,
    seed: int = 123,
    within: Sequence[str] = (),
    lead: Sequence[str] = (),
    rank: str = "rank",
    total: str | None = None,
    digits: int | None = None,
) -> DataFrame:
    """1-based row number in (``lead``, hash, key) order inside each ``within`` group.

    The first ``digits`` hex digits of the hash are the bucket, so a group with a third of
    all rows is spread over ``16 ** digits`` buckets of equal size; by default there are as
    many as the counted rows need. ``lead`` columns must have few values (a class, a rounded
    score).
    """
    within, lead = list(within), list(lead)
    if digits is None:
        n = df.select(F.count(F.lit(1))).first()[0]
        digits = max(2, math.ceil(math.log(max(n / BUCKET_ROWS, 1), 16)))
    rows = df.withColumn("__hr_hash", hash_of(key, seed)).withColumn("__hr_bucket", F.substring("__hr_hash", 1, digits))
    place = [*within, *lead, "__hr_bucket"]
    counts = rows.groupBy(*place).agg(F.count(F.lit(1)).alias("__hr_n"))
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    before = group.orderBy(*lead, "__hr_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *place,
        F.coalesce(F.sum("__hr_n").over(before), F.lit(0)).alias("__hr_offset"),
        F.sum("__hr_n").over(group).alias("__hr_total"),
    )
    local = F.row_number().over(Window.partitionBy(*place).orderBy("__hr_hash", key))
    ranked = join_null_safe(rows, offsets, place).withColumn(rank, (F.col("__hr_offset") + local).cast("long"))
    if total:
        ranked = ranked.withColumn(total, F.col("__hr_total"))
    return ranked.drop("__hr_hash", "__hr_bucket", "__hr_offset", "__hr_total")


def ntile_of(rank: Column | str, total: Column | str, k: int) -> Column:
    """Tile number (1..k) of a row from its global rank, with the sizes of SQL ``ntile``."""
    r = F.col(rank) if isinstance(rank, str) else rank
    n = F.col(total) if isinstance(total, str) else total
    small = F.floor(n / F.lit(k))
    extra = n - small * F.lit(k)
    edge = extra * (small + 1)
    return (
        F.when(r <= edge, F.floor((r - 1) / (small + 1)) + 1)
        .otherwise(extra + F.floor((r - 1 - edge) / F.greatest(small, F.lit(1))) + 1)
        .cast("int")
    )


def first_by_hash(df: DataFrame, key: str, n: int, seed: int = 123) -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer) chosen by hash order, for any ``n``."""
    return hash_rank(df, key, seed, rank="__rank").where(F.col("__rank") <= n).drop("__rank")


def highest(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The ``k`` rows with the highest score; ties go to the smaller key, a missing score comes last.

    Each task keeps its own ``k`` best rows and only those meet, so ``df`` is read once and ``k`` bounds what one task
    holds: it is the size of a batch that people review, not a share of the data.
    """
    return df.orderBy(F.col(score).cast("double").desc_nulls_last(), F.col(key)).limit(k)


def cut_points(values: DataFrame, value: str, within: Sequence[str] = (), parts: int = 64) -> DataFrame:
    """Per group, some ``parts`` cut points of near equal depth: (``within``, __cuts), one row a group.

    ``values`` has one row per (``within``, ``value``). The sample of a group is the values
    whose hash falls under a share set by the group's size, so it is bounded, and the same
    whenever Spark evaluates it again: bucket numbers never disagree.
    """
    within, step, steps = list(within), 4, 1 << 30
    known = values.where(F.col(value).isNotNull()).select(*within, value)
    if within:
        sizes = known.groupBy(*within).agg(F.count(F.lit(1)).alias("__size"))
        known = join_null_safe(known, sizes, within)
    else:
        known = known.withColumn("__size", known.select(F.count(F.lit(1))).scalar())
    share = F.lit(float(parts * step)) / F.col("__size")
    sample = known.where(F.pmod(F.xxhash64(F.lit(31), value), F.lit(steps)) < share * steps)
    ordered = F.array_sort(F.collect_list(value))
    return sample.groupBy(*within).agg(F.filter(ordered, lambda _x, i: (i + 1) % step == 0).alias("__cuts"))


def running_totals(
    counts: DataFrame,
    value: str,
    sums: Sequence[str],
    within: Sequence[str] = (),
    descending: bool = False,
    parts: int = 64,
) -> DataFrame:
    """Add ``cum_<s>`` (inclusive) and ``all_<s>`` for each of ``sums``, in ``value`` order.

    ``counts`` has one row per (``within``, ``value``), so a hot value is one row. Each group
    has cut points of its own, so its buckets are of near equal depth however narrow its
    values are; ``parts`` buckets a group, more where the caller has more than ``parts`` million
    distinct values.
    """
    within = list(within)
    below = F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col(value))), F.lit(0))
    cuts = cut_points(counts, value, within, parts)
    rows = join_null_safe(counts, cuts, within) if within else counts.withColumn("__cuts", cuts.select("__cuts").scalar())
    rows = rows.withColumn("__bucket", -below if descending else below).drop("__cuts")
    place = [*within, "__bucket"]
    totals = rows.groupBy(*place).agg(*[F.sum(s).alias(f"__{s}") for s in sums])
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    before = group.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *place,
        *[F.coalesce(F.sum(f"__{s}").over(before), F.lit(0)).alias(f"__off_{s}") for s in sums],
        *[F.sum(f"__{s}").over(group).alias(f"all_{s}") for s in sums],
    )
    order = F.col(value).desc() if descending else F.col(value).asc()
    inside = Window.partitionBy(*place).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = join_null_safe(rows, offsets, place)
    return joined.withColumns({f"cum_{s}": F.col(f"__off_{s}") + F.sum(s).over(inside) for s in sums}).drop(
        "__bucket", *[f"__off_{s}" for s in sums]
    )


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], within: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles per group from counts of distinct values.

    Spark's ``percentile`` keeps every distinct value of a group in one buffer; this
    keeps only the rows next to each wanted rank.
    """
    within = list(within)
    counts = df.where(F.col(value).isNotNull()).groupBy(*within, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(counts, value, ["n"], within)
    low, high = {}, {}
    for name, p in probs.items():
        place = (F.col("all_n") - 1) * F.lit(float(p))
        holds = lambda pos: (F.col("cum_n") - F.col("n") <= pos) & (pos < F.col("cum_n"))
        low[name] = F.max(F.when(holds(F.floor(place)), F.col(value)))
        high[name] = F.max(F.when(holds(F.ceil(place)), F.col(value)))
    aggs = [F.max("all_n").alias("n")]
    for name in probs:
        aggs += [low[name].alias(f"__lo_{name}"), high[name].alias(f"__hi_{name}")]
    edges = ranked.groupBy(*within).agg(*aggs)
    out = []
    for name, p in probs.items():
        place = (F.col("n") - 1) * F.lit(float(p))
        share = place - F.floor(place)
        out.append((F.col(f"__lo_{name}") + (F.col(f"__hi_{name}") - F.col(f"__lo_{name}")) * share).alias(name))
    return edges.select(*within, "n", *out)
