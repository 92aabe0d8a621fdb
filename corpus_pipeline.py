"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, mixing, and byte-level BPE, each over all that the one before kept.

Each stage takes (spark, docs, folder) and gives back a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last give back the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weaklabel.llm import bpe, line_dedup, mixing, simhash, toxicity
from weaklabel.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the toxicity grammar scores under its threshold."""
    labels = table(spark, folder, "labels").where(~toxicity.held_out("doc_id"))
    grammar = toxicity.learn(docs, labels)
    return toxicity.score(docs, grammar, COLUMNS).where("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without runs of lines that also start earlier; n_chars is that of the new text."""
    cleaned = line_dedup.remove_repeated_lines(docs)
    chars = F.when(F.col("__n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast("long")
    return cleaned.withColumn("n_chars", chars).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies; a null id is the smallest."""
    return simhash.survivors(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken."""
    return mixing.whole_copies(mixing.mix(docs, COLUMNS), COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Each document with its token count, the digest of its ids and that of what they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_decode(docs, path, public_tokenizers.PATTERN, ["doc_id", "source"]).select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: SQL can express neither the learned grammar nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over documents, each written before the next."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, folder), f"pipeline-{name}")
    return docs
