"""Helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weaklabel.session import cut_lineage, shared_path

#: Characters between words, as a Spark and Python pattern and as byte values.
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACES = (32, 9, 10, 11, 12, 13)

#: Stands for a null id: it sorts before every other id.
NULL_ID = -(2**63)


def whole(name: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_key(name: str) -> Column:
    """An integer id with null as the smallest id."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def n_words(text: Column) -> Column:
    """How many runs of non-space characters a text has."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the text of each is at most ``most_bytes``, or one row if that is longer."""
    for batch in batches:
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, before + most_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to


def raw_texts(column: pa.Array) -> list[memoryview]:
    """The UTF-8 bytes of each text of an Arrow column, without a copy; null is empty."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = memoryview(column.buffers()[2] or b"")
    return [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and go on from that table, which survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def smallest_reachable(links: DataFrame, rounds: int = 200) -> DataFrame:
    """Connected components of the undirected links (a, b): rows (node, root) for every linked node, root the smallest.

    Large-star and small-star steps in turn: each node's neighbours are hung onto its smallest neighbour until nothing
    moves. Rows only ever shrink to one per node, joins go by node and minima combine before they are shuffled, so a node
    with a third of all links is no hot group. ``rounds`` only stops a faulty run: steps needed grow with the logarithm.
    """
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    for _ in range(rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(*[F.struct(F.col(c).alias("u"), F.col("m").alias("v")) for c in ("u", "v")])
        small = large.join(low, "u").select(F.explode(pairs).alias("e")).select("e.u", "e.v")
        after = cut_lineage(small.where("u > v").distinct())
        same = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        moved = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        old, new = same.first(), moved.first()
        edges = after
        if old == new:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
