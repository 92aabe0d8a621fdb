"""Substring dedup: windows of words that also start earlier lose their words.

Super-k-mer partitioning. A window is ``window`` consecutive words of one document. Its minimiser is the smallest hashed
run of ``minimiser`` words in it, so equal windows have equal minimisers. Consecutive windows that share a minimiser
travel as one packed string to the bucket of that minimiser; in a bucket, sorting the hashes of all windows brings equal
ones together, and their words are compared, so counts are exact.

Skew. Word runs that make up over 1/10,000 of all positions are found first (at most 10,000 by count, whatever the input)
and are ranked last as minimisers, so a passage that a third of all documents share does not draw the unique windows at
its edges into one bucket. Within each slice of a task, windows that repeat are decided at once and only the first of
them travels, so a bucket gets a hot window at most once a slice. The number of buckets follows from the counted words,
so that a bucket holds about ``bucket_bytes`` at every input size. A bucket may be larger, as one minimiser is never two
buckets: one of more than ``LARGE`` times that is compared in turns, each of them over the windows whose hash falls to it
(equal windows fall to the same), so that what a turn lays out is bounded and only the packed strings lie in memory whole.

Defined cases: null texts have no words; a null doc_id is the smallest id; rows with equal doc_id and different text are
ordered by the text's hash; wholly repeated rows are one document and get the same result each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weaklabel.llm.common import NULL_ID, SPACES, id_key, raw_texts, slices, whole

SLICE_BYTES = 2 << 20
HASHED_WORDS = 1 << 16
HOT_SHARE = 10_000
LARGE = 4
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_BYTE_CODES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 2**64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, at least ``n`` of them."""
    if not _powers or len(_powers[0]) < n:
        made = []
        for base in (_STEP, _BACK):
            x = np.full(max(n, 1 << 20), base, dtype=np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        _powers[:] = made
    return _powers[0], _powers[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of some texts in one byte string, joined by one space, with hashes of any run of words."""

    def __init__(self, texts: list) -> None:
        joined = np.frombuffer(b" ".join([*texts, b""]) or b" ", dtype=np.uint8)
        space = _IS_SPACE[joined]
        after_word = np.empty_like(space)
        after_word[0] = False
        np.logical_not(space[:-1], out=after_word[1:])
        first = np.flatnonzero(~space & ~after_word)
        gap = space & after_word
        last = np.flatnonzero(gap)
        sizes = last - first
        self.bytes = np.where(space, np.uint8(32), joined)[~space | gap]
        self.start = np.cumsum(sizes + 1) - (sizes + 1)
        self.end = self.start + sizes
        begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])]) if texts else np.zeros(0, dtype=np.int64)
        self.doc = np.searchsorted(begins, first, side="right") - 1
        counts = np.bincount(self.doc, minlength=len(texts)) if len(first) else np.zeros(len(texts), dtype=np.int64)
        self.counts = counts
        self.first_word = np.cumsum(counts) - counts
        self.size = len(first)

    def hashes(self, length: int) -> np.ndarray:
        """A hash of each run of ``length`` words, by its first word; runs may cross documents.

        The bytes of a run times powers of a number, summed; taken over some thousand words at a time, as only the run
        itself counts, wherever it stands.
        """
        n = self.size - length + 1
        out = np.zeros(max(n, 0), dtype=np.uint64)
        for a in range(0, n, HASHED_WORDS):
            b = min(a + HASHED_WORDS, n)
            low, high = int(self.start[a]), int(self.end[b + length - 2])
            up, down = _power_tables(high - low + 1)
            sums = np.zeros(high - low + 1, dtype=np.uint64)
            np.cumsum(_BYTE_CODES[self.bytes[low:high]] * up[: high - low], out=sums[1:])
            first, last = self.start[a:b] - low, self.end[a + length - 1 : b + length - 1] - low
            out[a:b] = _mixed((sums[last] - sums[first]) * down[first])
        return out

    def inside(self, length: int) -> np.ndarray:
        """Whether the run of ``length`` words from each word lies in one document."""
        n = self.size - length + 1
        return self.doc[:n] == self.doc[length - 1 :] if n > 0 else np.zeros(0, dtype=bool)


def _repeats(words: Words, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows that start at words ``at`` (ascending): those equal to an earlier one, and the first equal one."""
    h = words.hashes(length)[at]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return at[:0], at[:0]
    head = np.concatenate([[True], ~same])
    firsts = at[order[np.flatnonzero(head)[np.cumsum(head) - 1]]]
    later, first = at[order[~head]], firsts[~head]
    back = np.argsort(later)
    later, first = later[back], first[back]
    cut = np.flatnonzero((np.diff(later) != 1) | (np.diff(first) != 1)) + 1
    data = words.bytes.tobytes()
    good = np.ones(len(later), dtype=bool)
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(later)]):
        if _text(words, data, later[a], later[b - 1], length) != _text(words, data, first[a], first[b - 1], length):
            good[a:b] = [_text(words, data, x, x, length) == _text(words, data, y, y, length) for x, y in zip(later[a:b], first[a:b])]
    if not good.all():  # different words with one hash: go by the words themselves
        bad, seen, more = set(h[np.searchsorted(at, later[~good])].tolist()), {}, []
        for i in at[np.isin(h, np.array(sorted(bad), dtype=np.uint64))].tolist():
            f = seen.setdefault(_text(words, data, i, i, length), i)
            if f != i:
                more.append((i, f))
        keep = ~np.isin(h[np.searchsorted(at, later)], np.array(sorted(bad), dtype=np.uint64))
        pairs = sorted([*zip(later[keep].tolist(), first[keep].tolist()), *more])
        later, first = np.array([p[0] for p in pairs], dtype=np.int64), np.array([p[1] for p in pairs], dtype=np.int64)
    return later, first


def _text(words: Words, data: bytes, a: int, b: int, length: int) -> bytes:
    """The words of windows ``a`` to ``b``."""
    return data[words.start[a] : words.end[b + length - 1]]


def _runs(at: np.ndarray, *also: np.ndarray) -> list[tuple[int, int]]:
    """Index ranges of ``at`` in which it goes up by one and each of ``also`` stays the same."""
    if not len(at):
        return []
    cut = np.diff(at) != 1
    for x in also:
        cut |= x[1:] != x[:-1]
    edges = (np.flatnonzero(cut) + 1).tolist()
    return list(zip([0, *edges], [*edges, len(at)]))


def _minimisers(words: Words, window: int, length: int, hot: np.ndarray) -> np.ndarray:
    """The smallest hash of ``length`` words in each window; hashes in ``hot`` come after all others."""
    h = words.hashes(length) >> np.uint64(1)
    if len(hot):
        cells = np.zeros(1 << 16, dtype=bool)
        cells[(hot & np.uint64(0xFFFF)).astype(np.int64)] = True
        maybe = np.flatnonzero(cells[(h & np.uint64(0xFFFF)).astype(np.int64)])
        place = np.minimum(np.searchsorted(hot, h[maybe]), len(hot) - 1)
        h[maybe[hot[place] == h[maybe]]] |= np.uint64(1 << 63)
    need, width = window - length + 1, 1
    least = h
    while width * 2 <= need:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if need > width:
        more = need - width
        least = np.minimum(least[: len(least) - more], least[more:])
    return least


def _frequent(length: int):
    """Word runs that are frequent in a slice, and how many runs there are (a null row)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            words = Words(raw_texts(part.column("text")))
            h = words.hashes(length)[words.inside(length)] >> np.uint64(1)
            least = max(2, -(-len(h) // HOT_SHARE))
            cell = (h & np.uint64(0xFFFFF)).astype(np.int64)
            heavy = np.bincount(cell, minlength=1 << 20) >= least
            found, n = np.unique(h[heavy[cell]], return_counts=True)
            found, n = found[n >= least], n[n >= least]
            yield pa.record_batch(
                [pa.array([None, *found.astype(np.int64).tolist()], pa.int64()), pa.array([words.size, *n.tolist()], pa.int64())], names=["run", "n"]
            )

    return count


def _pack(window: int, length: int, hot: np.ndarray, buckets: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for part in slices(batches, "text", SLICE_BYTES):
            ids = np.asarray(part.column("id"))
            marks = np.asarray(part.column("mark"))
            rows, seen = [], set()
            for i in np.lexsort((marks, ids)).tolist():
                if (key := (ids[i], marks[i])) not in seen:
                    seen.add(key)
                    rows.append(i)
            texts = raw_texts(part.column("text"))
            words = Words([texts[i] for i in rows])
            ids, marks = ids[rows], marks[rows]
            at = np.flatnonzero(words.inside(window))
            out = []
            later, _ = _repeats(words, at, window)
            if len(later):
                spans = _runs(later, words.doc[later])
                a, b = later[[x for x, _ in spans]], later[[y - 1 for _, y in spans]]
                d = words.doc[a]
                begin = a - words.first_word[d]
                out.append((int(ids[d[0]]) % buckets, squeeze.compress(_spans_blob(ids[d], marks[d], begin, b - a + begin + window))))
            at = np.setdiff1d(at, later, assume_unique=True)
            if len(at):
                least = _minimisers(words, window, length, hot)[at]
                spans = np.array(_runs(at, least), dtype=np.int64)
                a, b = at[spans[:, 0]], at[spans[:, 1] - 1]
                bucket = (_mixed(least[spans[:, 0]]) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                a, b, bucket = a[order], b[order], bucket[order]
                data = words.bytes.tobytes()
                d = words.doc[a]
                begin, stop = words.start[a], words.end[b + window - 1]
                edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(a)]
                for x, y in zip(edges[:-1], edges[1:]):
                    text = b" ".join([data[p:q] for p, q in zip(begin[x:y].tolist(), stop[x:y].tolist())])
                    e = d[x:y]
                    head = struct.pack("<BI", 0, y - x) + ids[e].astype("<i8").tobytes() + marks[e].astype("<i8").tobytes()
                    head += (a[x:y] - words.first_word[e]).astype("<i4").tobytes() + (b[x:y] - a[x:y] + 1).astype("<i4").tobytes()
                    out.append((int(bucket[x]), squeeze.compress(head + text)))
            if out:
                yield pa.record_batch([pa.array([k for k, _ in out], pa.int64()), pa.array([v for _, v in out], pa.binary())], names=["bucket", "packed"])

    return pack


def _spans_blob(ids: np.ndarray, marks: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> bytes:
    return struct.pack("<BI", 1, len(ids)) + b"".join(x.astype(t).tobytes() for x, t in ((ids, "<i8"), (marks, "<i8"), (begin, "<i4"), (stop, "<i4")))


def _spans_batch(ids, marks, begin, stop) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(begin, pa.int32()), pa.array(stop, pa.int32())], names=["id", "mark", "begin", "stop"]
    )


def _bucket_spans(parts: list[bytes], window: int) -> pa.RecordBatch | None:
    """Word spans to remove, from the super-k-mers of one bucket."""
    ids, marks, begin, count, texts = [], [], [], [], []
    for p in parts:
        (n,) = struct.unpack_from("<I", p, 1)
        at = 5
        for into, kind, width in ((ids, "<i8", 8), (marks, "<i8", 8), (begin, "<i4", 4), (count, "<i4", 4)):
            into.append(np.frombuffer(p, dtype=kind, count=n, offset=at))
            at += n * width
        texts.append(memoryview(p)[at:])
    ids, marks, begin, count = (np.concatenate(x) for x in (ids, marks, begin, count))
    words = Words(texts)
    n_of = count.astype(np.int64) + window - 1  # words of each packed string
    first = np.cumsum(n_of) - n_of
    order = np.lexsort((begin, marks, ids))  # windows in the order of documents: by string, then by place
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count[order]) - count[order], count[order])
    owner = np.repeat(order, count[order])
    at = first[owner] + within
    h = words.hashes(window)[at]
    by = np.argsort(h, kind="stable")
    same = np.concatenate([[False], h[by][1:] == h[by][:-1]])
    if not same.any():
        return None
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))
    later, lead = by[same], by[head[same]]
    data = words.bytes.tobytes()
    groups: dict[int, dict[bytes, int]] = {}
    gone = []
    back = np.argsort(later)
    later, lead = later[back], lead[back]
    cut = np.flatnonzero((np.diff(later) != 1) | (np.diff(lead) != 1) | (np.diff(at[later]) != 1) | (np.diff(at[lead]) != 1)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(later)]):
        x, y, p, q = at[later[a]], at[later[b - 1]], at[lead[a]], at[lead[b - 1]]
        if _text(words, data, x, y, window) == _text(words, data, p, q, window):
            gone.append((later[a:b], lead[a:b]))
            continue
        for i, f in zip(later[a:b].tolist(), lead[a:b].tolist()):  # one hash for different words: go by the words
            seen = groups.setdefault(int(h[i]), {_text(words, data, at[f], at[f], window): f})
            f = seen.setdefault(_text(words, data, at[i], at[i], window), i)
            if f != i:
                gone.append((np.array([i]), np.array([f])))
    if not gone:
        return None
    later, lead = np.concatenate([x for x, _ in gone]), np.concatenate([y for _, y in gone])
    p, q = owner[later], owner[lead]
    place, lead_place = begin[p] + within[later], begin[q] + within[lead]
    later = later[(ids[p] != ids[q]) | (marks[p] != marks[q]) | (place != lead_place)]  # a wholly repeated row is no earlier document
    if not len(later):
        return None
    later = np.sort(later)
    spans = _runs(later, owner[later])
    a, b = later[[x for x, _ in spans]], later[[y - 1 for _, y in spans]]
    o = owner[a]
    start = begin[o] + within[a]
    return _spans_batch(ids[o], marks[o], start, start + (b - a) + window)


def _turn_of(part: bytes, window: int, turns: int, turn: int) -> bytes:
    """The windows of packed super-k-mers whose hash falls to ``turn``, each packed by itself."""
    (n,) = struct.unpack_from("<I", part, 1)
    at = 5
    columns = []
    for kind, width in (("<i8", 8), ("<i8", 8), ("<i4", 4), ("<i4", 4)):
        columns.append(np.frombuffer(part, dtype=kind, count=n, offset=at))
        at += n * width
    ids, marks, begin, count = columns
    words = Words([memoryview(part)[at:]])
    n_of = count.astype(np.int64) + window - 1
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    starts = np.repeat(np.cumsum(n_of) - n_of, count) + within
    own = _mixed(words.hashes(window)[starts] ^ np.uint64(_STEP)) % np.uint64(turns) == turn
    owner, starts, within = np.repeat(np.arange(n), count)[own], starts[own], within[own]
    data = words.bytes.tobytes()
    text = b" ".join([data[p:q] for p, q in zip(words.start[starts].tolist(), words.end[starts + window - 1].tolist())])
    head = ids[owner].astype("<i8").tobytes() + marks[owner].astype("<i8").tobytes()
    head += (begin[owner] + within).astype("<i4").tobytes() + np.ones(len(owner), dtype="<i4").tobytes()
    return struct.pack("<BI", 0, len(owner)) + head + text


def _compare(window: int, bucket_bytes: int):
    def spans(parts: list[bytes], size: int) -> Iterator[pa.RecordBatch]:
        """Spans of a bucket from its squeezed parts, at once or in turns."""
        open_ = zstandard.ZstdDecompressor()
        if size <= LARGE * bucket_bytes:
            turns = [[open_.decompress(p) for p in parts]] if parts else []
        else:
            # a window by itself takes more bytes than in the run that it came in, where a window adds some three words
            n = -(-size * window // (3 * bucket_bytes))
            turns = ([t for t in (_turn_of(open_.decompress(p), window, n, k) for p in parts) if t[1:5] != b"\0\0\0\0"] for k in range(n))
        for own in turns:
            if own and (found := _bucket_spans(own, window)):
                yield found

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        now, parts, size = None, [], 0
        for batch in batches:
            for bucket, packed in zip(batch.column("bucket").to_pylist(), batch.column("packed")):
                if bucket != now:
                    yield from spans(parts, size)
                    now, parts, size = bucket, [], 0
                squeezed = packed.as_py()
                p = open_.decompress(squeezed)
                if p[0] == 0:
                    parts.append(squeezed)
                    size += len(p)
                    continue
                (n,) = struct.unpack_from("<I", p, 1)
                yield _spans_batch(*(np.frombuffer(p, dtype=k, count=n, offset=5 + n * o) for k, o in (("<i8", 0), ("<i8", 8), ("<i4", 16), ("<i4", 20))))
        yield from spans(parts, size)

    return compare


def repeated_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 20, minimiser: int = 2, bucket_bytes: int = 8 << 20) -> DataFrame:
    """Spans of words to remove: id, mark (hash of the text), begin, stop (word numbers); spans of a document may overlap.

    ``bucket_bytes`` bounds what one turn of the comparing tasks lays out, about tenfold in memory.
    """
    keyed = docs.select(id_key(id_column).alias("id"), F.xxhash64(whole(text_column)).alias("mark"), whole(text_column).alias("text"))
    runs = keyed.select("text").mapInArrow(_frequent(minimiser), "run long, n long").groupBy("run").agg(F.sum("n").alias("n"))
    total = runs.where("run is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    # at most HOT_SHARE rows, as the counts of different runs sum up to no more than the total
    hot = runs.where("run is not null").where(F.col("n") * HOT_SHARE > total).select("run")
    ranked_last = np.array(sorted(r["run"] for r in hot.collect()), dtype=np.uint64)
    width = window - minimiser + 1
    packed_bytes = total * 6.5 * (window + width / 2) / (width / 2)
    buckets = max(1, int(packed_bytes / bucket_bytes))
    packed = keyed.mapInArrow(_pack(window, minimiser, ranked_last, buckets), "bucket long, packed binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_compare(window, bucket_bytes), "id long, mark long, begin int, stop int")


def _keep(columns: list[str]):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            texts, shas, sizes, gone = [], [], [], []
            for text, spans in zip(raw_texts(part.column("text")), part.column("spans").to_pylist()):
                words = bytes(text).split()
                n = len(words)
                if spans:
                    change = np.zeros(n + 1, dtype=np.int32)
                    np.add.at(change, [s["begin"] for s in spans], 1)
                    np.add.at(change, [s["stop"] for s in spans], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                kept = b" ".join(words)
                sizes.append(n)
                gone.append(n - len(words))
                shas.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept)
            made = {"n_words": pa.array(sizes, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(shas, pa.string())}
            if "kept_text" in columns:
                made["kept_text"] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.record_batch([part.column("id") if c == "doc_id" else made[c] for c in columns], names=columns)

    return keep


def remove_repeated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 20, minimiser: int = 2, with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text."""
    spans = repeated_spans(docs, id_column, text_column, window, minimiser)
    spans = spans.groupBy("id", "mark").agg(F.collect_list(F.struct("begin", "stop")).alias("spans"))
    keyed = docs.select(id_key(id_column).alias("id"), F.xxhash64(whole(text_column)).alias("mark"), whole(text_column).alias("text"))
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])]
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    done = keyed.join(spans, ["id", "mark"], "left").select("id", "text", "spans").mapInArrow(_keep(columns), schema)
    return done.withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(NULL_ID)))
