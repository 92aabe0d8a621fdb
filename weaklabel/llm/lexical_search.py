"""Ranked lexical search by NRA: sequential reads of impact-sorted postings, and score intervals until all is resolved.

Documents are cut into slices of bounded text as they are read. A slice's postings of the query terms are one row of a
written table: term, document and how often, with each document's length. Counts over all slices give the numbers that
scores need (documents, their terms, documents a term), and a second pass ranks each slice on its own.

In a slice the postings of a term are read from the highest impact down, a stretch of all of an item's terms at a time,
never looking up a document. What was read of a document is its lower bound; with it and the next unread impact of each
term that was not met for it, its upper bound. Reading goes on until no document outside the best ``k`` can reach them, no
document whose bounds still allow a tie is open, and the scores of the best are final. So a slice gives its exact best
``k``, equal scores in order of document ids, and the best of all slices are the answer. A bar from the ``k``-th best scores
of a few slices, which are exact scores of documents too, lets the others stop sooner: a slice that can't reach it hands on
nothing.

Nothing is shuffled but term counts, combined per slice, and k rows an item and slice; a frequent word is one stretch of
each slice's row. Items go to the driver in blocks of ``ITEMS``, and each block makes its own pass.

Scores are whole numbers: see ``impacts`` and ``weights``.

Defined cases: a null or empty text has no terms, as document or item, and an item without terms, or whose terms no
document has, gives no rows; a very long text is read whole, a slice of its own if need be; repeated document rows are
ranked each; a null doc_id is the smallest; equal item rows are one item, and different texts of one item_id are one item
with the terms of all; a null item_id is an item like any other; scores of 0 are left out; empty tables give an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weaklabel.llm.common import NULL_ID, id_key, raw_texts, slices, whole, written

SLICE_BYTES = 8 << 20
SLICE_DOCS = 16_384
ITEMS = 2_000
STRETCH = 32
#: ASCII letters and digits, the former in lower case, and all bytes of other characters are parts of terms.
_FOLD = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return text.translate(_FOLD).split(b" ")


def impacts(tf: np.ndarray, n: np.ndarray, total_docs: int, total_terms: int) -> np.ndarray:
    """What a term that comes ``tf`` times in a document of ``n`` terms adds, before its weight."""
    if int(n.max(initial=0)) * 75 * total_docs >= 1 << 63:
        m = np.array([25 + 75 * int(x) * total_docs // total_terms for x in n.tolist()], dtype=np.int64)
    else:
        m = 25 + (75 * n * total_docs) // total_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weights(df: dict[int, int], total_docs: int) -> dict[int, int]:
    """The weight of each term from the number of documents that hold it."""
    return {t: math.floor(1000 * math.log((2 * total_docs + 2) / (2 * d + 1))) for t, d in df.items()}


def index(docs: DataFrame, vocabulary: list[bytes], id_column: str, text_column: str) -> DataFrame:
    """One row a slice: ids and lengths of its documents, and postings by term of ``vocabulary``, in a written table."""
    places = {t: i for i, t in enumerate(vocabulary)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = places.keys()
        for batch in slices(batches, "text", SLICE_BYTES):
            for at in range(0, batch.num_rows, SLICE_DOCS):
                part = batch.slice(at, SLICE_DOCS)
                lengths, held = [], []
                term, doc, tf = [], [], []
                for i, text in enumerate(raw_texts(part.column("text"))):
                    words = terms_of(bytes(text))
                    counts = Counter(words)
                    lengths.append(len(words) - counts[b""])
                    for word in counts.keys() & known:
                        term.append(places[word])
                        doc.append(i)
                        tf.append(counts[word])
                lengths = np.array(lengths, dtype=np.int64)
                order = np.argsort(np.array(term, dtype=np.int64), kind="stable")
                found, counts = np.unique(np.array(term, dtype=np.int32), return_counts=True)
                held = [np.array(x, dtype=k)[order] for x, k in ((doc, np.int32), (tf, np.int64))]
                yield pa.record_batch(
                    [
                        pa.array([int((lengths > 0).sum())]),
                        pa.array([int(lengths.sum())]),
                        pa.array([found.tolist()], pa.list_(pa.int32())),
                        pa.array([counts.tolist()], pa.list_(pa.int64())),
                        *(pa.array([x.tobytes()], pa.binary()) for x in (np.asarray(part.column("id")), lengths, *held)),
                    ],
                    names=["n_docs", "n_terms", "terms", "sizes", "ids", "lengths", "docs", "tfs"],
                )

    rows = docs.select(id_key(id_column).alias("id"), whole(text_column).alias("text"))
    shape = "n_docs long, n_terms long, terms array<int>, sizes array<long>, ids binary, lengths binary, docs binary, tfs binary"
    return written(rows.mapInArrow(work, shape), "lexical-index")


def nra(lists: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, k: int, bar: int = 0, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray, int]:
    """The best ``k`` documents above 0 and not under ``bar``, best first, with their scores, and how many postings were read.

    ``lists`` has the documents (indices of ``ids``) and scores of each term, highest score first.
    """
    n = len(ids)
    low, unmet = np.zeros(n, dtype=np.int64), np.ones((len(lists), n), dtype=bool)
    next_ = np.zeros(len(lists), dtype=np.int64)
    at, read = 0, 0
    while True:
        for t, (docs, scores) in enumerate(lists):
            part = docs[at : at + stretch]
            if len(part):
                low[part] += scores[at : at + stretch]
                unmet[t, part] = False
                read += len(part)
            next_[t] = scores[at + stretch] if at + stretch < len(scores) else 0
        at += stretch
        stretch *= 2
        # a document can't gain from a term whose list is at its end
        live = np.flatnonzero(next_)
        high = low + next_[live] @ unmet[live] if len(live) else low
        kth = np.partition(low, n - k)[n - k] if n >= k else 0
        # any document that may still be among the best, or tie with them, must have its final score
        need = max(int(kth), bar, 1)
        hopeful = np.flatnonzero(high >= need)
        if (low[hopeful] == high[hopeful]).all():
            order = hopeful[np.lexsort((ids[hopeful], -low[hopeful]))][:k]
            return order, low[order], read


def _rank(items: list[list[tuple[int, int]]], weight: dict[int, int], total_docs: int, total_terms: int, k: int, bars: list[int]):
    by_term = defaultdict(list)
    for number, own in enumerate(items):
        for t, times in own:
            by_term[t].append((number, times))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                read = lambda name, kind: np.frombuffer(batch.column(name)[r].as_py(), dtype=kind)  # noqa: B023, E731
                ids, lengths, docs, tfs = read("ids", np.int64), read("lengths", np.int64), read("docs", np.int32), read("tfs", np.int64)
                stops = np.cumsum(np.asarray(batch.column("sizes")[r].values))
                gains = impacts(tfs, lengths[docs], total_docs, total_terms) if len(docs) else tfs
                lists = defaultdict(list)
                for t, stop, before in zip(batch.column("terms")[r].values.to_pylist(), stops.tolist(), [0, *stops[:-1].tolist()]):
                    own = np.argsort(-gains[before:stop], kind="stable") + before
                    for number, times in by_term[t]:
                        if weight[t] > 0:
                            lists[number].append((docs[own], gains[own] * (weight[t] * times)))
                out = [nra(own, ids, k, bars[number]) for number, own in lists.items()]
                yield pa.record_batch(
                    [
                        pa.array(np.repeat(np.array(list(lists), dtype=np.int32), [len(o[0]) for o in out])),
                        pa.array(np.concatenate([ids[o[0]] for o in out]) if out else np.zeros(0, dtype=np.int64)),
                        pa.array(np.concatenate([o[1] for o in out]) if out else np.zeros(0, dtype=np.int64)),
                    ],
                    names=["item", "doc_id", "score"],
                )

    return work


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    first_slices: int = 8,
) -> DataFrame:
    """item_id, rank, doc_id and score of each item's best ``k`` documents; the bar comes from about ``first_slices`` slices."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_column).alias("item_id"), whole(item_text_column).alias("text")).distinct()
    kind = dict(asked.dtypes)["item_id"]
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(max(1, math.ceil(asked.count() / ITEMS)))))
    parts = []
    for block in [r["block"] for r in asked.select("block").distinct().orderBy("block").collect()]:
        texts = defaultdict(list)
        for r in asked.where(F.col("block") == block).select("item_id", F.col("text").cast("binary").alias("text")).collect():
            texts[r["item_id"]] += [t for t in terms_of(bytes(r["text"])) if t]
        names = list(texts)
        vocabulary = sorted({t for own in texts.values() for t in own})
        if not vocabulary:
            continue
        place = {t: i for i, t in enumerate(vocabulary)}
        numbered = [sorted((place[t], n) for t, n in Counter(texts[i]).items()) for i in names]
        table = index(docs, vocabulary, id_column, text_column)
        total_docs, total_terms, rows = table.agg(F.sum("n_docs"), F.sum("n_terms"), F.count("*")).first()
        if not total_docs:
            continue
        pairs = table.select(F.explode(F.arrays_zip("terms", "sizes")).alias("p")).groupBy("p.terms").agg(F.sum("p.sizes").alias("df"))
        weight = weights({r["terms"]: r["df"] for r in pairs.collect()}, total_docs)
        rank = lambda bars: _rank(numbered, weight, total_docs, total_terms, k, bars)  # noqa: B023, E731
        shape = "item int, doc_id long, score long"
        bars = [0] * len(names)
        share = F.pmod(F.xxhash64("ids"), F.lit(max(1, rows // first_slices))) == 0
        if rows > 2 * first_slices:
            firsts = _best(table.where(share).mapInArrow(rank(bars), shape), k).where(F.col("rank") == k)
            for r in firsts.select("item", "score").collect():
                bars[r["item"]] = r["score"]
        best = _best(table.mapInArrow(rank(bars), shape), k)
        labels = spark.createDataFrame(list(enumerate(names)), f"item int, item_id {kind}")
        parts.append(best.join(labels, "item").select("item_id", "rank", F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), "score"))
    if not parts:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    whole_answer = parts[0]
    for part in parts[1:]:
        whole_answer = whole_answer.unionByName(part)
    return whole_answer
