"""Document fingerprints by a randomised edit embedding.

A walk reads a text: at step j it puts out the character it stands on and then, by a random bit that depends on j and that
character and is the same for all texts, stays or moves on one character. Two texts that differ by few edits fall back
into step soon after each edit, so the edit distance of the texts maps to the Hamming distance of the walks' outputs. After
the last character a walk puts out an end mark.

The fingerprint samples the walk's output at fixed random steps: ``SAMPLES`` steps in each octave of steps [2^k, 2^(k+1)), a
4-bit code of the character for each, as hex digits; the octave in which the walk ends is the last. The likeness of two
fingerprints is the share of equal samples, octaves weighted by their number of steps and steps after both ends left out:
an estimate of the share of steps at which the walks agree. Equal texts have equal fingerprints.

For near pairs, ``near_classes`` makes bands of some samples each, more of them and longer ones the more documents there are,
compares all members of a band by the likeness, and joins the near ones into classes.

Walks of many texts go on side by side in numpy; the few long texts that are left in the end go on alone. Memory is bounded
by the slice of texts and one text.

Defined cases: a null text is the empty text, with one end mark; a null doc_id is the smallest id; rows of equal doc_id are
ordered by the text's hash; a single document is its own next one; an empty table gives an empty result; repeated rows have
equal fingerprints; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weaklabel.llm.common import NULL_ID, id_key, raw_texts, slices, smallest_reachable, whole, written
from weaklabel.llm.simhash import _forest

SAMPLES = 32
SLICE_BYTES = 8 << 20
RANGE_CHARS = 64 << 20
ALONE = 48
_PERIOD = 1 << 12
_END = 255
_draw = np.random.default_rng(10)
#: Random bits by step (modulo a period) and symbol; the end mark never moves on.
_MOVES = _draw.integers(0, 2, (_PERIOD, 256), dtype=np.uint8)
_MOVES[:, _END] = 0
_ROWS = [r.tobytes() for r in _MOVES]
#: Codes put out for a symbol; code 0 is the end mark's alone.
_CODES = _draw.integers(1, 16, 256, dtype=np.uint8)
_CODES[_END] = 0


def sampled_steps(octave: int) -> list[int]:
    """The steps of an octave that are sampled, in order; all of them if there are few."""
    low = 1 << octave
    if low <= SAMPLES:
        return list(range(low, 2 * low))
    # spread over the octave: one random step of each of SAMPLES equal parts
    part = low // SAMPLES
    return [low + i * part + int(x) for i, x in enumerate(np.random.default_rng([10, octave]).integers(0, part, SAMPLES))]


def symbols_of(text: str) -> np.ndarray:
    """A byte for each code point; never the end mark."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    mixed = (points * np.uint32(2654435761)) >> np.uint32(24)
    return np.where(points < 128, points, 128 + mixed % 127).astype(np.uint8)


def _walk(texts: list[np.ndarray]) -> list[np.ndarray]:
    """The sampled codes of each text's walk, octave after octave, up to the octave in which it ends."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    flat = np.full(int(sizes.sum()) + len(texts), _END, dtype=np.uint8)
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    for t, b in zip(texts, begins.tolist()):
        flat[b : b + len(t)] = t
    stops = begins + sizes
    out: list[list[np.ndarray]] = [[] for _ in texts]
    live = np.arange(len(texts))
    at = begins.copy()
    moves, codes = _MOVES, _CODES
    step, octave = 1, 0
    while len(live) > ALONE:
        low, high = 1 << octave, 2 << octave
        picks = sampled_steps(octave)
        codes_here = np.zeros((len(live), len(picks)), dtype=np.uint8)
        kept = np.arange(len(live))  # walks that have not ended within this octave
        now, k = at, 0
        for step in range(low, high):
            symbol = flat[now]
            if k < len(picks) and picks[k] == step:
                codes_here[kept, k] = codes[symbol]
                k += 1
            now = now + moves[step % _PERIOD].take(symbol)
            if step % 64 == 0 and len(now):
                going = now < stops[live[kept]]
                if not going.all():
                    at[kept] = now
                    kept, now = kept[going], now[going]
                if not len(kept):
                    break
        at[kept] = now
        for i, own in zip(live.tolist(), codes_here):
            out[i].append(own)
        # a walk that stands at its end has an end mark at the next octave's first step: it goes no further
        on = at < stops[live]
        live, at = live[on], at[on]
        octave += 1
    for i, p in zip(live.tolist(), at.tolist()):
        own = flat[begins[i] : stops[i] + 1].tobytes()
        p -= int(begins[i])
        out[i].extend(_walk_alone(own, p, octave))
    return [np.concatenate(o) if o else np.zeros(0, dtype=np.uint8) for o in out]


def _walk_alone(own: bytes, p: int, octave: int) -> list[np.ndarray]:
    """The rest of one walk, from position ``p`` at the start of an octave."""
    found, end = [], len(own) - 1
    while p < end:
        low, high = 1 << octave, 2 << octave
        picks = [*sampled_steps(octave), high]
        codes_here, step = np.zeros(len(picks) - 1, dtype=np.uint8), low
        for k, pick in enumerate(picks):
            while step < pick:
                to = min(pick, (step // _PERIOD + 1) * _PERIOD)
                for row in _ROWS[step % _PERIOD : step % _PERIOD + to - step]:
                    p += row[own[p]]
                step = to
                if p == end:
                    break
            if p == end and step < pick:
                step = pick
            if k < len(picks) - 1:
                codes_here[k] = _CODES[own[p]]
        found.append(codes_here)
        octave += 1
    return found


_HEX = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)


def fingerprints_of(texts: list[str]) -> list[str]:
    """The fingerprint of each text: a hex digit for each sampled step."""
    walked = _walk([symbols_of(t) for t in texts])
    return [_HEX[w].tobytes().decode() or "0" for w in walked]


def _octaves(n: int) -> list[int]:
    """How many samples each octave has in a fingerprint of ``n`` samples."""
    sizes, k = [], 0
    while n > 0:
        sizes.append(min(1 << k, SAMPLES))
        n -= sizes[-1]
        k += 1
    return sizes


def likeness(a: str, b: str) -> float:
    """The estimated share of steps at which two walks agree, from 0 to 1."""
    if a == b:
        return 1.0
    n = max(len(a), len(b))
    x, y = (np.frombuffer(s.encode().ljust(n, b"0"), dtype=np.uint8) for s in (a, b))
    sizes = _octaves(n)
    weight = np.repeat([(1 << k) / s for k, s in enumerate(sizes)], sizes)[:n]
    counted = (x != 48) | (y != 48)
    both = weight[counted].sum()
    return float((weight * ((x == y) & counted)).sum() / both) if both else 1.0


def fingerprints(docs: DataFrame, keep: list[str], text_column: str = "text") -> DataFrame:
    """Columns ``keep`` of every row with its fingerprint."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text", SLICE_BYTES):
            marks = fingerprints_of(part.column("__text").to_pylist())
            yield pa.record_batch([*(part.column(c) for c in keep), pa.array(marks, pa.string())], names=[*keep, "fingerprint"])

    kept = docs.select(*keep, whole(text_column).alias("__text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]
    return kept.mapInArrow(work, ", ".join([*kinds, "fingerprint string"]))


def samples_for(rows: int) -> int:
    """Samples a band: so many that the chance of two unrelated fingerprints to share one is far below 1 in ``rows``."""
    return max(5, math.ceil((math.log2(max(rows, 2)) + 3) / 3))


def bands_for(samples: int, least: float) -> int:
    """Bands an octave: a pair that agrees on a share ``least`` of its samples is met in one with a chance of 0.9."""
    return math.ceil(math.log(10) / least**samples)


def _banded(samples: int, bands: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws: dict[tuple[int, int], list[tuple[int, ...]]] = {}
        for batch in batches:
            nodes, keys = [], []
            for node, mark in zip(batch.column("node").to_pylist(), batch.column("fingerprint").to_pylist()):
                sizes = _octaves(len(mark))
                for level in range(max(0, len(sizes) - 2), len(sizes)):
                    if (level, sizes[level]) not in draws:
                        draws[level, sizes[level]] = [tuple(np.random.default_rng([10, level, b]).integers(0, sizes[level], samples).tolist()) for b in range(bands)]
                    own, at = mark[sum(sizes[:level]) : sum(sizes[: level + 1])], f"{level}:"
                    for b, draw in enumerate(draws[level, sizes[level]]):
                        keys.append(xxhash.xxh64_intdigest(f"{at}{b}:" + "".join([own[x] for x in draw])) - (1 << 63))
                        nodes.append(node)
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(nodes, pa.int64())], names=["band", "node"])

    return work


def likenesses(a: list[str], b: list[str]) -> np.ndarray:
    """``likeness`` of every fingerprint of ``a`` with every one of ``b``."""
    n = max(map(len, [*a, *b]))
    x, y = (np.frombuffer("".join(m.ljust(n, "0") for m in marks).encode(), dtype=np.uint8).reshape(-1, n) for marks in (a, b))
    sizes = _octaves(n)
    weight = np.repeat([(1 << k) / s for k, s in enumerate(sizes)], sizes)[:n]
    # equal samples, code by code; where both have ended there is nothing to compare
    ended = ((x == 48) * weight) @ (y == 48).T.astype(float)
    equal = sum(((x == c) * weight) @ (y == c).T.astype(float) for c in np.unique(x) if c != 48)
    both = weight.sum() - ended
    return np.where(both > 1e-9, equal / np.maximum(both, 1e-9), 1.0)


def _verified(least: float):
    """Links of each tile of a band, as a spanning forest; rows come sorted by tile."""

    def links(marks: list[str], nodes: np.ndarray, cuts: np.ndarray, first: int, second: int) -> tuple[np.ndarray, np.ndarray]:
        left, right = np.flatnonzero(cuts == first), np.flatnonzero(cuts == second)
        if not len(left) or not len(right):
            return nodes[:0], nodes[:0]
        near = likenesses([marks[i] for i in left], [marks[j] for j in right]) >= least
        i, j = np.nonzero(near)
        i, j = left[i], right[j]
        i, j = (i[i < j], j[i < j]) if first == second else (i, j)
        kept = _forest(i, j, len(marks))
        return nodes[i[kept]], nodes[j[kept]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _with_end(batches):
            table = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if table is None or not table.num_rows:
                continue
            names = np.stack([np.asarray(table.column(c)) for c in ("band", "first", "second")])
            cuts = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1).tolist()]
            if batch is None:
                cuts.append(table.num_rows)
            found = []
            for a, b in zip(cuts, cuts[1:]):
                part = table.slice(a, b - a)
                found.append(links(part.column("fingerprint").to_pylist(), np.asarray(part.column("node")), np.asarray(part.column("cut")), int(names[1, a]), int(names[2, a])))
            rest = table.slice(cuts[-1])
            if found:
                yield pa.record_batch([pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], names=["a", "b"])

    return work


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_classes(marks: DataFrame, least: float = 0.8, samples: int | None = None, bands: int | None = None, tile: int = 512) -> DataFrame:
    """h, g (hashes of a fingerprint, see ``mark_hashes``) and class_id, the smallest id of its class, of documents (id, fingerprint).

    A band is some random positions of one of the last two octaves of a walk, which hold three quarters of its steps. All
    members of a band are compared; a band with many of them, as of texts that share their end, is cut into tiles of about
    ``tile`` rows, and every two tiles meet in a task of their own. Pairs of likeness ``least`` are linked, classes are the
    connected components. Copies of one fingerprint are one first.
    """
    nodes = marks.groupBy(*mark_hashes()).agg(F.first("fingerprint").alias("fingerprint"), F.min("id").alias("first"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "edit-marks")
    samples = samples or samples_for(nodes.count())
    bands = bands or bands_for(samples, least)
    banded = nodes.select("node", "fingerprint").mapInArrow(_banded(samples, bands), "band long, node long").distinct()
    held = written(banded, "edit-bands")
    cuts = held.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band", F.ceil(F.col("n") / tile).cast("int").alias("cuts"))
    cuts = written(cuts, "edit-cuts")
    dealt = held.join(cuts, "band").withColumn("cut", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda j: F.struct(F.least(F.col("cut"), j).alias("first"), F.greatest(F.col("cut"), j).alias("second")))
    tiles = dealt.select("band", "node", "cut", F.explode(pairs).alias("t")).select("band", "t.*", "node", "cut")
    tiles = tiles.join(nodes.select("node", "fingerprint"), "node").repartition("band", "first", "second").sortWithinPartitions("band", "first", "second")
    links = written(tiles.select("band", "first", "second", "node", "cut", "fingerprint").mapInArrow(_verified(least), "a long, b long"), "edit-links")
    placed = nodes.join(smallest_reachable(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("class_id"))
    return placed.join(smallest, "root").select("h", "g", "class_id")


def mark_hashes() -> list[Column]:
    """Two hashes that stand for a fingerprint where it would be long to move."""
    return [F.xxhash64("fingerprint").alias("h"), F.xxhash64(F.lit(1), "fingerprint").alias("g")]


def with_classes(found: DataFrame, least: float = 0.8) -> DataFrame:
    """``found`` (doc_id, fingerprint and more) with class_id, the smallest doc_id whose fingerprint is near or is linked by near ones."""
    found = written(found, "edit-found")
    classes = near_classes(found.select(id_key("doc_id").alias("id"), "fingerprint"), least)
    hashed = found.select("*", *mark_hashes())
    return hashed.join(classes, ["h", "g"]).select(*found.columns, F.nullif(F.col("class_id"), F.lit(NULL_ID)).alias("class_id"))


def _edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by the first code points of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _compared(rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
    """A result row for each (id, text, next text); a text that stands in several places is walked once."""
    edits = [_edited(t, f) for _, t, f in rows]
    texts = list({t: None for _, own, following in rows for t in (own, following)})
    marks = dict(zip(texts, fingerprints_of(texts)))
    edited = fingerprints_of(edits)
    own = [marks[t] for _, t, _ in rows]
    columns = {
        "id": pa.array([i for i, _, _ in rows], pa.int64()),
        "n_chars": pa.array([len(t) for _, t, _ in rows], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits]),
        "fingerprint": pa.array(own),
        "edited_fingerprint": pa.array(edited),
        "near_edited": pa.array([likeness(a, b) for a, b in zip(own, edited)], pa.float64()),
        "near_next": pa.array([likeness(a, marks[f]) for a, (_, _, f) in zip(own, rows)], pa.float64()),
    }
    return pa.record_batch(list(columns.values()), names=list(columns))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come part by part in the order of documents, the borrowed row last: each is worked out with the row after it."""
    before, open_ = None, zstandard.ZstdDecompressor()
    rows, size = [], 0
    for batch in batches:
        for part, i, packed, borrowed in zip(*(batch.column(c).to_pylist() for c in ("part", "id", "packed", "borrowed"))):
            text = open_.decompress(packed).decode()
            if before is not None and before[0] == part and not before[3]:
                rows.append((before[1], before[2], text))
                size += len(text)
            before = (part, i, text, borrowed)
            if size > SLICE_BYTES:
                yield _compared(rows)
                rows, size = [], 0
    if rows:
        yield _compared(rows)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as they travel."""
    close = zstandard.ZstdCompressor(level=3)
    for part in slices(batches, "text", SLICE_BYTES):
        cells = pa.array([close.compress(t) for t in raw_texts(part.column("text"))], pa.binary())
        yield pa.record_batch([*(part.column(c) for c in ("part", "id", "mark", "borrowed")), cells], names=["part", "id", "mark", "borrowed", "packed"])


def with_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of each document, its edited text, and the likeness to that and to the next document, by descending id.

    Documents are dealt to ranges of (id, hash of the text), about ``RANGE_CHARS`` characters each. The range before borrows
    the first document of a range as its last row, the last range borrows the very first, so that each range has what it
    needs. Borders come from a sample by hash of a bounded number of documents a range; they and the first documents are as
    many as there are ranges.
    """
    spark = docs.sparkSession
    keyed = docs.select(id_key(id_column).alias("id"), F.xxhash64(whole(text_column)).alias("mark"), whole(text_column).alias("text"))
    rows, chars = keyed.agg(F.count("*"), F.sum(F.length("text"))).first()
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), (chars or 0) // RANGE_CHARS)
    share = F.pmod(F.xxhash64(F.lit(3), "id", "mark"), F.lit(max(1, rows // (64 * n)))) == 0
    sample = sorted({(r["id"], r["mark"]) for r in keyed.where(share).select("id", "mark").distinct().collect()})
    cuts = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []
    borders = F.array(*[F.struct(F.lit(i).cast("long").alias("id"), F.lit(m).cast("long").alias("mark")) for i, m in cuts]).cast("array<struct<id:bigint,mark:bigint>>")
    ranged = keyed.withColumn("part", F.size(F.filter(borders, lambda c: c >= F.struct("id", "mark"))))  # part 0 has the largest ids
    heads = ranged.groupBy("part").agg(F.max(F.struct("id", "mark")).alias("head")).orderBy("part").collect()
    lent = [(h["head"]["id"], h["head"]["mark"], heads[k - 1]["part"]) for k, h in enumerate(heads)]
    lent = F.broadcast(spark.createDataFrame(lent, "id long, mark long, lent int"))  # a row a part
    own = F.struct(F.col("part"), F.lit(False).alias("borrowed"))
    other = F.struct(F.col("lent").alias("part"), F.lit(True).alias("borrowed"))
    places = F.explode(F.when(F.col("lent").isNull(), F.array(own)).otherwise(F.array(own, other)))
    rows = ranged.join(lent, ["id", "mark"], "left").select("id", "mark", "text", places.alias("place")).select("id", "mark", "text", "place.*")
    rows = rows.mapInArrow(_packed, "part int, id long, mark long, borrowed boolean, packed binary")
    rows = rows.repartition(n, "part").sortWithinPartitions("part", "borrowed", F.desc("id"), F.desc("mark"))
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    done = rows.select("part", "id", "packed", "borrowed").mapInArrow(_pairs, schema)
    return done.select(F.nullif(F.col("id"), F.lit(NULL_ID)).alias("doc_id"), *done.columns[1:])
