"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame functions only.

Sizes are words. Sources in code-point order (null last) get the weights of ``weights`` in turn; a source's target is its
share by weight of all words, but at most ``most_times`` its own size, and what that leaves over is shared again by weight
until no target is above its limit.

All words are cut into blocks of ``block`` words. Seats, one for each block, go to the sources with the highest quotients
target / (2 s + 1), s being the seats a source has already; a source's seats go to its shards likewise by the shards' sizes.
Documents are dealt to shards by a hash of their id, about ``shard_words`` words a shard, so a source with a third of all
rows is many shards. A shard lays its documents out in an order drawn by ``seed`` and takes its quota of blocks from the
start, going round again where the quota is more than the shard holds; so a document is taken up to ``most_times`` times,
the one at the last border in part. Documents without words, of which nothing is taken, go by the part of the input that they
come from, so a shard's rows are bounded by its words; rows without an id are dealt by their text.

Highest quotients without sorting all of them: with the divisors sum / (seats + n / 2) and sum / (seats - n / 2), rounding
gives at least and at most the seats of n parties, so only the few quotients between the two are laid out and ranked.

Defined cases: a null text has no words; a null source is a source of its own; a null doc_id is dealt by the text; rows of
one id and size go by a hash of their text, so that reruns agree; repeated rows are separate documents next to each other,
each with its share; a source without words has target 0; no words at all give targets and takings of 0; an empty table gives
an empty result; other columns are kept only if asked for. Sources are rows of one small table: there may be many, but far
fewer than documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weaklabel.llm.common import n_words, whole, written

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
BLOCK = 16
SHARD_WORDS = 250_000
SEED = 11


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """``sizes`` (source, source_size; one row a source) with target.

    The limit ``most_times * size`` is reached first where it is smallest against the weight. In that order, the level
    that shares the rest by weight is the first at which the next source stays under its limit.
    """
    in_order = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn))
    limit = F.col("source_size").cast("double") * most_times
    weighed = weighed.withColumn("limit", limit).withColumn("reach", F.col("limit") / F.col("weight"))
    upward = Window.orderBy("reach", F.col("source").isNull(), "source")
    before, rest = upward.rowsBetween(Window.unboundedPreceding, -1), upward.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = F.sum(F.col("source_size").cast("double")).over(Window.partitionBy())
    level = (everything - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    levels = weighed.withColumn("level", F.when(level <= F.col("reach"), level))
    # the first level that holds; levels and reaches rise together, so all later ones hold too
    chosen = levels.withColumn("level", F.first("level", ignorenulls=True).over(upward.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    shared = F.coalesce(F.least(F.col("limit"), F.col("level") * F.col("weight")), F.col("limit"))
    return chosen.select("source", "source_size", shared.alias("target"))


def seats(parties: DataFrame, votes: str, of: Column, within: list[str], order: list[Column]) -> DataFrame:
    """``parties`` with column seats: ``of`` seats dealt by the highest quotients of ``votes`` among rows alike in ``within``."""
    group = Window.partitionBy(*within)
    v = F.col(votes).cast("double")
    known = parties.withColumns({"__of": of.cast("double"), "__sum": F.sum(v).over(group), "__n": F.sum(F.when(v > 0, 1).otherwise(0)).over(group)})
    low = F.when(F.col("__of") > F.col("__n") / 2, F.round(v / F.col("__sum") * (F.col("__of") - F.col("__n") / 2)) - 1).otherwise(0.0)
    high = F.round(v / F.col("__sum") * (F.col("__of") + F.col("__n") / 2)) + 1
    known = known.withColumns({"__low": F.when(v > 0, F.greatest(low, F.lit(0.0))).otherwise(0.0), "__high": F.when(v > 0, high).otherwise(0.0)})
    known = known.withColumn("__left", F.col("__of") - F.sum("__low").over(group))
    steps = F.sequence(F.lit(0), (F.col("__high") - F.col("__low") - 1).cast("int"))
    laid = known.withColumn("__step", F.explode_outer(F.when(F.col("__high") > F.col("__low"), steps)))
    quotient = v / (2 * (F.col("__low") + F.col("__step")) + 1)
    ranked = laid.withColumn("__rank", F.row_number().over(group.orderBy(quotient.desc_nulls_last(), *order)))
    won = F.when(F.col("__step").isNotNull() & (F.col("__rank") <= F.col("__left")), 1).otherwise(0)
    names = [F.col(c) for c in parties.columns]
    return ranked.groupBy(*names).agg((F.max("__low") + F.sum(won)).cast("long").alias("seats"))


def _shard(shards: Column) -> Column:
    """The shard of a document, by its id."""
    return F.pmod(F.conv(F.substring(F.md5(_name()), 1, 8), 16, 10).cast("long"), shards)


def _name(salt: str = "") -> Column:
    return F.concat("__name", F.lit(f":{salt}"))


def mix(
    docs: DataFrame,
    keep: list[str],
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most_times: int = MOST_TIMES,
    block: int = BLOCK,
    shard_words: int = SHARD_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """Columns ``keep`` of every row with size, source_size, target (of its source) and taken, the words the mix takes."""
    text, source = whole(text_column), F.col(source_column).cast("string")
    name = F.coalesce(F.col(id_column).cast("string"), F.concat(F.lit("-"), F.md5(text)))
    # a null source and its rows meet by a name that no source has
    rows = docs.select(
        *keep,
        F.col(id_column).alias("__id"),
        name.alias("__name"),
        F.xxhash64(text).alias("__mark"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("~")).alias("__source"),
        n_words(text).alias("size"),
    )
    # words are counted once: where texts are kept, apart from them
    if text_column in keep:
        measured = written(rows.select("__name", "__source", "size"), "mix-sizes")
    else:
        rows = measured = written(rows, "mix-sizes")
    sizes = measured.groupBy("__source").agg(F.sum("size").alias("source_size"))
    sizes = sizes.select(F.when(F.col("__source") != "~", F.substring("__source", 2, 2**31 - 1)).alias("source"), "source_size")
    aimed = targets(sizes, weights, most_times)
    aimed = aimed.withColumn("__source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("~")))
    total = F.sum(F.col("source_size").cast("double")).over(Window.partitionBy())
    dealt = seats(aimed.withColumn("__blocks", F.round(total / block)), "target", F.col("__blocks"), [], [F.col("__source")])
    dealt = dealt.select("__source", "source_size", "target", F.col("seats").alias("__seats"), F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("long").alias("__shards"))
    # a row a source: from a written table Spark knows whether it is small enough to be broadcast
    dealt = written(dealt, "source-seats")
    part = F.spark_partition_id().cast("long")
    place = lambda frame: frame.withColumn("__part", part).join(dealt, "__source").withColumn("__shard", F.when(F.col("size") > 0, _shard(F.col("__shards"))).otherwise(-1 - F.col("__part")))
    shards = place(measured).where("size > 0").groupBy("__source", "__shard", "__seats").agg(F.sum("size").alias("__words"))
    quotas = seats(shards, "__words", F.col("__seats"), ["__source"], [F.col("__shard")])
    quotas = quotas.select("__source", "__shard", F.least(F.col("seats") * block, F.col("__words") * most_times).alias("__quota"), "__words")
    drawn = Window.partitionBy("__source", "__shard").orderBy(F.md5(_name(str(seed))), "__id", "size", "__mark")
    # dealt by shard, so that no task gets a source as a whole
    laid = place(rows).repartition("__source", "__shard").join(quotas, ["__source", "__shard"], "left")
    laid = laid.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("__quota", "__words")})
    start = F.sum("size").over(drawn.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    rounds = F.when(F.col("__words") > 0, F.floor(F.col("__quota") / F.col("__words"))).otherwise(0)
    rest = F.col("__quota") - rounds * F.col("__words")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    return laid.withColumn("taken", taken.cast("long")).select(*keep, "size", "source_size", "target", "taken")


def whole_copies(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the documents of a mix, each as often as the nearest whole number of times it is taken."""
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return mixed.withColumn("__copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>")))).select(*columns)
