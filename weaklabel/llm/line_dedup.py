"""Line dedup: runs of lines that also start earlier are deleted, with DataFrame functions only.

A run is some consecutive lines of one document with at least ``min_chars`` characters in all, a line break for each line
counted. A line goes if it lies in a run whose lines also start earlier, at a smaller doc_id or further up.

The lines of all documents are one table (document, place, line), and the suffixes of documents are ranked over it by prefix
doubling. Lines that come more than once are sorted, and their order is the rank of a suffix by its first line. The rank by
2^(k+1) lines is the order of the pairs of ranks by 2^k lines at the suffix and 2^k lines further on; each round is a sorted
window over documents, a count and a distributed sort of the pairs that come more than once, and a join. Suffixes of equal
rank are an interval of the suffix array whose common prefix is that long. Suffixes that stand alone are dropped on the
way: most lines never take part.

The prefixes asked about are the shortest runs of ``min_chars`` characters that start at a line and those that end at one: a
maximal repeated run is covered by these and holds no others that are not repeated, so what is deleted is exactly the later
copies of all maximal repeated runs. A prefix of any length is named by its length and two ranks, those of the two powers
of two that overlap in it. Such a prefix has at most ``min_chars`` lines, which bounds the rounds at any size of input, and
only lines shorter than ``min_chars`` need more than the first rank.

The first place of each interval is a minimum that combines before it is shuffled, so a line that a third of all documents
hold is no hot group; the joins are such that Spark can split them by skew. A window over a long document is sorted and
spills; no list holds more than ``min_chars`` lines.

Defined cases: a null text stays null and has no lines; a null doc_id is the smallest id; rows of equal doc_id and
different text are ordered by the text's hash; wholly repeated rows are one document and get the same result each; an
empty table gives an empty result. Lines end at ``\\n`` alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weaklabel.llm.common import id_key, whole, written

MIN_CHARS = 30


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(id_key(id_column).alias("id"), F.xxhash64(whole(text_column)).alias("mark"), F.col(text_column).cast("string").alias("text"))


def _ranked(groups: DataFrame, order: list[str], name: str) -> DataFrame:
    """``groups`` with rank, numbers that rise in ``order``: a distributed sort, numbered part by part."""
    return written(groups.select(*order).orderBy(*order).withColumn("rank", F.monotonically_increasing_id()), name)


def repeated_lines(docs: DataFrame) -> DataFrame:
    """id, mark, place (from 1), chars (with the line break) and rank of every line that comes more than once, written."""
    lines = docs.select("id", "mark", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.select("id", "mark", (F.col("at") + 1).alias("place"), F.unhex(F.md5("line")).alias("name"), (F.char_length("line") + 1).alias("chars"))
    lines = written(lines, "lines")
    more = lines.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
    ranks = _ranked(more, ["name"], "line-ranks")
    # wholly repeated rows are one document
    return written(lines.join(ranks, "name").drop("name").dropDuplicates(["id", "mark", "place"]), "repeated-lines")


def asked_runs(lines: DataFrame, least: int) -> DataFrame:
    """id, mark, place and n_lines of the shortest runs of repeated lines with ``least`` characters that start or end at a line."""
    by_place = Window.partitionBy("id", "mark").orderBy("place")
    one = F.struct("place", "chars")

    def shortest(near: Column, step: int) -> Column:
        """How many lines it takes, going through ``near`` by ``step``; null if there are too few without a gap."""
        start = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("lines"), F.lit(True).alias("whole"))

        def add(a: Column, x: Column) -> Column:
            here = a["whole"] & (x["place"] == F.col("place") + step * a["lines"])
            more = F.struct((a["chars"] + x["chars"]).alias("chars"), (a["lines"] + 1).alias("lines"), F.lit(True).alias("whole"))
            gap = F.struct(a["chars"], a["lines"], F.lit(False).alias("whole"))
            return F.when(a["chars"] >= least, a).when(here, more).otherwise(gap)

        return F.aggregate(near, start, add, lambda a: F.when(a["chars"] >= least, a["lines"]))

    ahead = F.collect_list(one).over(by_place.rowsBetween(0, least - 1))
    behind = F.reverse(F.collect_list(one).over(by_place.rowsBetween(1 - least, 0)))
    near = lines.select("id", "mark", "place", "chars", ahead.alias("ahead"), behind.alias("behind"))
    from_here = F.struct("place", shortest(F.col("ahead"), 1).alias("n_lines"))
    back = shortest(F.col("behind"), -1)
    to_here = F.struct((F.col("place") + 1 - back).alias("place"), back.alias("n_lines"))
    # a line that is long enough is both
    runs = F.when(F.col("chars") >= least, F.array(F.struct("place", F.lit(1).alias("n_lines")))).otherwise(F.array_distinct(F.array(from_here, to_here)))
    return near.select("id", "mark", F.inline(F.filter(runs, lambda r: r["n_lines"].isNotNull())))


def doubled(ranks: DataFrame, level: int) -> DataFrame:
    """Ranks (id, mark, place, rank) by 2^(level + 1) lines from those by 2^level; suffixes that stand alone have none."""
    by_place = Window.partitionBy("id", "mark").orderBy("place")
    step = 1 << level
    # if a repeated run goes on so far, no rank on the way is missing: the row that many rows on is at that place
    pairs = ranks.withColumns({"next": F.lead("rank", step).over(by_place), "at": F.lead("place", step).over(by_place)})
    pairs = pairs.where(F.col("at") == F.col("place") + step).select("id", "mark", "place", F.col("rank").alias("own"), "next")
    more = pairs.groupBy("own", "next").agg(F.count("*").alias("n")).where("n > 1")
    return pairs.join(_ranked(more, ["own", "next"], f"line-ranks-{level + 1}"), ["own", "next"]).select("id", "mark", "place", "rank")


def _named(lines: DataFrame, runs: DataFrame) -> DataFrame:
    """The runs (id, mark, place, n_lines) that come more than once, perhaps, with the two ranks that name them."""
    key = ["id", "mark", "place"]
    single = runs.where("n_lines = 1").join(lines.select(*key, F.col("rank").alias("head")), key).select(*key, "n_lines", "head", F.col("head").alias("tail"))
    several = written(runs.where("n_lines > 1"), "line-runs")
    longest = several.agg(F.max("n_lines")).first()[0] or 1
    inside = several.select("id", "mark", F.explode(F.sequence(F.col("place"), F.col("place") + F.col("n_lines") - 1)).alias("place")).distinct()
    ranks = lines.select(*key, "rank").join(inside, key)
    tables = []
    for level in range(1, longest.bit_length()):
        ranks = written(doubled(ranks, level - 1), f"line-level-{level}")
        tables.append(ranks.withColumn("level", F.lit(level)))
    named = single
    if tables:
        every = reduce(DataFrame.unionByName, tables)
        level = F.floor(F.log2("n_lines") + 1e-9).cast("int")
        several = several.withColumn("level", level).withColumn("last", F.col("place") + F.col("n_lines") - F.expr("shiftleft(1, level)"))
        heads = every.withColumnRenamed("rank", "head")
        tails = every.select("id", "mark", F.col("place").alias("last"), "level", F.col("rank").alias("tail"))
        named = named.unionByName(several.join(heads, [*key, "level"]).join(tails, ["id", "mark", "last", "level"]).select(*key, "n_lines", "head", "tail"))
    return written(named, "line-named-runs")


def later_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Shortest runs that also start earlier: id, mark (hash of the text), place (line from 1), n_lines."""
    lines = repeated_lines(_keyed(docs.where(F.col(text_column).isNotNull()), id_column, text_column))
    runs = _named(lines, asked_runs(lines, min_chars))
    where, name = F.struct("id", "mark", "place"), ["n_lines", "head", "tail"]
    firsts = runs.groupBy(*name).agg(F.min(where).alias("first"), F.count("*").alias("n")).where("n > 1").select(*name, "first")
    # a written table, so that Spark can split the places of a line that very many documents hold
    firsts = written(firsts, "line-firsts")
    return runs.join(firsts, name).where(where > F.col("first")).select("id", "mark", "place", "n_lines")


def repeated_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """The stretches of lines that are deleted: doc_id, first_line (from 1), n_lines; neighbouring copies are merged."""
    lines = later_copies(docs, id_column, text_column, min_chars).select("id", "mark", F.explode(F.sequence(F.col("place"), F.col("place") + F.col("n_lines") - 1)).alias("line")).distinct()
    by_doc = lines.groupBy("id", "mark").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    numbered = by_doc.select("id", "mark", F.posexplode("lines").alias("i", "line"))
    return numbered.groupBy("id", "mark", (F.col("line") - F.col("i")).alias("stretch")).agg(F.min("line").alias("first_line"), F.count("*").alias("n_lines")).select(F.col("id").alias("doc_id"), "first_line", "n_lines")


def remove_repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """All rows and columns of ``docs`` with the kept text in place of the text, and __n_lines and __n_removed."""
    gone = later_copies(docs, id_column, text_column, min_chars)
    gone = gone.groupBy("id", "mark").agg(F.collect_set(F.struct("place", "n_lines")).alias("__gone"))
    gone = gone.select(F.col("id").alias("__id"), F.col("mark").alias("__mark"), "__gone")
    keyed = docs.withColumns({"__id": id_key(id_column), "__mark": F.xxhash64(whole(text_column))})
    joined = keyed.join(gone, ["__id", "__mark"], "left")
    text = F.col(text_column).cast("string")
    lines = F.split(text, "\n")
    covered = F.flatten(F.transform("__gone", lambda w: F.sequence(w["place"], w["place"] + w["n_lines"] - 1)))
    kept = F.array_except(F.sequence(F.lit(1), F.size(lines)), covered)
    done = joined.withColumns({"__lines": lines, "__kept": F.when(F.col("__gone").isNotNull() & text.isNotNull(), kept)})
    new_text = F.when(F.col("__kept").isNull(), text).otherwise(F.array_join(F.transform("__kept", lambda i: F.get(F.col("__lines"), i - 1)), "\n"))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size("__lines")).cast("long")
    done = done.withColumns({"__n_lines": n_lines, "__n_removed": F.when(F.col("__kept").isNull(), 0).otherwise(F.size("__lines") - F.size("__kept")).cast("long"), text_column: new_text})
    return done.select(*docs.columns, "__n_lines", "__n_removed")


def digest(cleaned: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    return cleaned.select(
        id_column,
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_removed").alias("n_removed"),
        F.sha2(whole(text_column), 256).alias("kept_sha256"),
    )
