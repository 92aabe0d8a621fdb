"""Joins, collapse, enrichment and column edits that build one row per unit.

No join here carries a broadcast hint: Spark broadcasts a side by itself when its
size is known to be under ``spark.sql.autoBroadcastJoinThreshold`` and shuffles
(with AQE skew splitting) beyond it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from weaklabel.functions.ranking import highest
from weaklabel.operators.quality import expect_unique
from weaklabel.session import written

SEP = ";;"


def select_matching(df: DataFrame, pattern: str, first: Sequence[str] = ()) -> list[str]:
    """Column names holding ``pattern``, in frame order, after ``first``."""
    return [*first, *[c for c in df.columns if re.search(pattern, c) and c not in first]]


def drop_matching(df: DataFrame, *patterns: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if any(re.search(p, c) for p in patterns)])


def map_values(column: str, mapping: Mapping[str, object]) -> Column:
    """Dictionary lookup; a value outside the dictionary gives NULL."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.col(column))


def override_cells(df: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """Replace cells of named rows. ``overrides`` has ``key`` and the columns to replace; NULL keeps."""
    columns = [c for c in overrides.columns if c != key]
    renamed = overrides.withColumnsRenamed({c: f"__new_{c}" for c in columns})
    joined = df.join(renamed, key, "left")
    return joined.withColumns({c: F.coalesce(f"__new_{c}", c) for c in columns}).select(*df.columns)


def outer_join(many: DataFrame, one: DataFrame, on: Sequence[str], null_safe: bool = False, write_first: bool = False) -> DataFrame:
    """Full outer equi join written as left join + unmatched right rows.

    Spark cannot split a skewed key in a full outer join but can in a left join, so a
    hot key on the ``many`` side stays spread. ``null_safe`` lets missing keys match
    each other. Other columns must have different names on both sides. The ``many`` side is read
    twice, its keys alone the second time; ``write_first`` writes it once before, for a side that
    costs more to work out than to write.
    """
    on = list(on)
    if write_first:
        many = written(many, "outer-join")
    # the many side's keys are thinned before they move: a hot key becomes one row per task
    seen = many.select(*on).distinct()
    extra_left = [c for c in many.columns if c not in on]
    extra_right = [c for c in one.columns if c not in on]
    if not null_safe:
        matched = many.join(one, on, "left")
        rest = one.join(seen, on, "left_anti")
    else:
        right = one.withColumnsRenamed({c: f"__r_{c}" for c in on})
        same = reduce(lambda a, b: a & b, [many[c].eqNullSafe(right[f"__r_{c}"]) for c in on])
        matched = many.join(right, same, "left").drop(*[f"__r_{c}" for c in on])
        unseen = reduce(lambda a, b: a & b, [seen[c].eqNullSafe(right[f"__r_{c}"]) for c in on])
        rest = right.join(seen, unseen, "left_anti").withColumnsRenamed({f"__r_{c}": c for c in on})
    columns = [*on, *extra_left, *extra_right]
    return matched.select(*columns).unionByName(rest.select(*on, *extra_right), allowMissingColumns=True)


def enrich(df: DataFrame, *tables: DataFrame, on: Sequence[str] = ("visit_occurrence_id",), check: bool = True) -> DataFrame:
    """Left-join one-row-per-key tables; ``check`` proves each key unique, so no row can double."""
    for table in tables:
        if check:
            expect_unique(table, *on)
        df = df.join(table, list(on), "left")
    return df


def refresh_features(df: DataFrame, families: Mapping[str, DataFrame], on: Sequence[str], check: bool = True) -> DataFrame:
    """Drop each feature family by name pattern and attach its current table.

    Returns a new frame; the caller's frame keeps its columns.
    """
    return enrich(drop_matching(df, *families), *families.values(), on=on, check=check)


def semi_join_any(df: DataFrame, key: str, *id_sets: DataFrame) -> DataFrame:
    """Rows whose key is in at least one id set."""
    ids = reduce(DataFrame.unionByName, [s.select(key) for s in id_sets]).distinct()
    return df.join(ids, key, "left_semi")


def with_membership(df: DataFrame, ids: DataFrame, key: str, flag: str) -> DataFrame:
    """Boolean column: is the key in ``ids``? Computed once, so rules can use it as a plain column."""
    known = ids.select(key).where(F.col(key).isNotNull()).distinct().withColumn(flag, F.lit(True))
    return df.join(known, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def exclude_owners(df: DataFrame, held_out: DataFrame, owner: str) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): rows of owners who do not / do own a held-out row."""
    owners = held_out.select(owner).distinct()
    return df.join(owners, owner, "left_anti"), df.join(owners, owner, "left_semi")


def _joined(column: str, missing: str, order_by: Sequence[str]) -> Column:
    """Ordered ``;;`` join of one column as an aggregate."""
    order = ", ".join(f"`{c}`" for c in order_by)
    text = f"coalesce(cast(`{column}` AS string), '{missing}')"
    return F.expr(f"listagg({text}, '{SEP}') WITHIN GROUP (ORDER BY {order})")


def hot_keys(rows: DataFrame, keys: Sequence[str], hot_rows: int | None = None) -> DataFrame:
    """The keys that hold more rows than an average shuffle partition, or than ``hot_rows``.

    By default there are fewer of them than shuffle partitions, whatever the input. They are written once, so
    that all reads agree and Spark, which then knows their size, can send them to all tasks by itself. The count
    combines before its shuffle; results do not depend on what counts as hot.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    if hot_rows is not None:
        return written(counts.where(F.col("__n") > hot_rows).select(*keys), "hot-keys")
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fair = rows.agg((F.count(F.lit(1)) / partitions).alias("fair")).scalar()
    return written(counts.where(F.col("__n") > fair).select(*keys), "hot-keys")


def collapse(
    df: DataFrame,
    keys: Sequence[str],
    columns: Mapping[str, str],
    order_by: Sequence[str],
    segment: Column | None = None,
    extra: Mapping[str, tuple[Column, Callable[[Column], Column]]] | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """One row per key with each of ``columns`` joined by ``;;`` in ``order_by`` order.

    ``columns`` maps column -> text used for a missing value. Rows with a missing key are
    dropped. ``order_by`` must be total up to equal values. ``segment`` is an expression
    that never falls along the first order column (a month of a date, say): the rows of a
    hot key (see ``hot_keys``) are joined per segment first, spread over tasks, and only the
    joined pieces meet. All other rows are moved once. ``extra`` maps a name to a further
    aggregate and to the function that merges its partial results.
    """
    keys, extra = list(keys), dict(extra or {})
    rows = df.dropna(subset=keys)
    lists = [_joined(c, m, order_by).alias(f"{c}_list") for c, m in columns.items()]
    more = [agg.alias(n) for n, (agg, _merge) in extra.items()]

    def grouped(part: DataFrame, by: list[str]) -> DataFrame:
        # lists do not shrink before a shuffle, so rows are placed once and grouped where they are
        return part.repartition(*by).groupBy(*by).agg(*lists, *more)

    if segment is None:
        return grouped(rows, keys)
    hot = hot_keys(rows, keys, hot_rows)
    partial = grouped(rows.join(hot, keys, "left_semi").withColumn("__seg", segment), [*keys, "__seg"])
    pieces = [_joined(f"{c}_list", "", ["__seg"]).alias(f"{c}_list") for c in columns]
    merged = partial.groupBy(*keys).agg(*pieces, *[merge(F.col(n)).alias(n) for n, (_agg, merge) in extra.items()])
    return grouped(rows.join(hot, keys, "left_anti"), keys).unionByName(merged)


def _merge_runs(parts: Column) -> Column:
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("n"), zero.alias("head"), zero.alias("tail"), zero.alias("best"))

    def step(acc: Column, p: Column) -> Column:
        return F.struct(
            (acc["n"] + p["n"]).alias("n"),
            F.when(acc["head"] == acc["n"], acc["n"] + p["head"]).otherwise(acc["head"]).alias("head"),
            F.when(p["tail"] == p["n"], acc["tail"] + p["n"]).otherwise(p["tail"]).alias("tail"),
            F.greatest(acc["best"], p["best"], acc["tail"] + p["head"]).alias("best"),
        )

    return F.aggregate(parts, start, step)


def longest_runs(
    df: DataFrame,
    keys: Sequence[str],
    matches: Mapping[str, Column],
    order_by: Sequence[str],
    segment: Column,
    hot_rows: int | None = None,
) -> DataFrame:
    """Longest run of consecutive matching rows per key, without building the joined text.

    Within a key, or a segment of a hot key, a row of a run has as many misses before it as
    every other row of that run: runs are counted by sorted windows that spill, no list of
    rows is built. A segment of a hot key ends as four numbers per match column, and these
    merge in segment order, so a key of any size ends as a few numbers.
    """
    keys = list(keys)
    rows = df.dropna(subset=keys).select(*keys, *[c for c in order_by if c not in keys], segment.alias("__seg"), *[F.coalesce(m, F.lit(False)).alias(f"__m_{n}") for n, m in matches.items()])
    hot = hot_keys(rows, keys, hot_rows)
    parts = rows.join(hot, keys, "left_anti").withColumn("__seg", F.lit(None).cast(rows.schema["__seg"].dataType))
    parts = parts.unionByName(rows.join(hot, keys, "left_semi")).repartition(*keys, "__seg")
    place = [*keys, "__seg"]
    upward = Window.partitionBy(*place).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = parts.withColumn("__at", F.count(F.lit(1)).over(upward))
    numbered = numbered.withColumns({f"__b_{n}": F.sum(F.when(F.col(f"__m_{n}"), 0).otherwise(1)).over(upward) for n in matches})
    # the row's place in its run: rows since the last miss
    lengths = {}
    for n in matches:
        miss = F.max(F.when(~F.col(f"__m_{n}"), F.col("__at"))).over(upward)
        lengths[f"__r_{n}"] = F.when(F.col(f"__m_{n}"), F.col("__at") - F.coalesce(miss, F.lit(0))).otherwise(0)
    numbered = numbered.withColumns(lengths)
    partial = numbered.groupBy(*place).agg(
        *[
            F.struct(
                F.count(F.lit(1)).alias("n"),
                F.max(F.when(F.col(f"__b_{n}") == 0, F.col(f"__r_{n}")).otherwise(0)).alias("head"),
                F.max_by(f"__r_{n}", "__at").alias("tail"),
                F.max(f"__r_{n}").alias("best"),
            ).alias(n)
            for n in matches
        ]
    )
    merged = partial.groupBy(*keys).agg(
        *[F.array_sort(F.collect_list(F.struct(F.col("__seg").alias("o"), F.col(n).alias("v")))).alias(n) for n in matches]
    )
    return merged.withColumns({n: _merge_runs(F.transform(n, lambda s: s["v"]))["best"] for n in matches})


def union_by_name(a: DataFrame, b: DataFrame, sort_columns: bool = False) -> DataFrame:
    """All rows of both; a column missing on one side is NULL there."""
    both = a.unionByName(b, allowMissingColumns=True)
    return both.select(*sorted(both.columns)) if sort_columns else both


def difference(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``other``."""
    return df.join(other.select(key).distinct(), key, "left_anti")


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str] | None, name: str, value: str) -> DataFrame:
    """Wide to long. ``values=None`` melts every column that is not an id, as double."""
    values = list(values or [c for c in df.columns if c not in ids])
    return df.select(*ids, *[F.col(v).cast("double") for v in values]).unpivot(list(ids), values, name, value)


def rows_at_max(df: DataFrame, column: str) -> DataFrame:
    """Every row that has the largest value, ties included."""
    return df.where(F.col(column) == df.agg(F.max(column)).scalar())


def top_k(df: DataFrame, score: str, key: str, k: int = 20) -> DataFrame:
    """The ``k`` rows with the highest score; ties go to the smaller key."""
    return highest(df, score, key, k)
