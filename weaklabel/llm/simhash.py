"""SimHash near-dedup: fingerprints of word shingles, linked at a small bit distance, and the groups that links form.

Links are found by tiled exact comparison. Equal fingerprints are first reduced to one. The population counts of the four
16-bit quarters of a fingerprint name its cell; a cell is cut into tiles of bounded size. Two fingerprints differ in at
least as many bits as the sum of the differences of their quarter counts, so tile pairs whose counts differ by more than
the radius are skipped, and all other pairs of tiles are compared whole by numpy exclusive-or and bit counts. A pair of
tiles gives no more links than it has fingerprints: those of a spanning forest of the links in it, which keeps every
connection, so a large group of near copies does not become a square of pairs. Groups are the connected components.

Cost. Comparing is quadratic in the number of different fingerprints; the four counts leave about 5 % of all pairs of
random fingerprints. Tile pairs are rows of a DataFrame, so the work spreads over all executors.

Defined cases: a null or empty text and one without words has fingerprint zero and is linked like any other; fewer words
than a shingle are one shingle; repeated rows share a group; a null doc_id is the smallest id and keeps a null
component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weaklabel.llm.common import NULL_ID, id_key, raw_texts, slices, smallest_reachable, whole, written

SLICE_BYTES = 4 << 20
TILE = 4096
_QUARTERS = 4


def _bits_of(words: list[bytes], width: int, seed: int) -> int:
    """The SimHash of the shingles of ``width`` words, repeats included."""
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [digest(b" ".join(words), seed)]
    else:
        line = b" ".join(words)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        stop = np.cumsum(sizes + 1) - 1
        starts, stops = (stop - sizes)[: len(words) - width + 1].tolist(), stop[width - 1 :].tolist()
        hashes = [digest(line[a:b], seed) for a, b in zip(starts, stops)]
    n = len(hashes)
    h = np.array(hashes, dtype="<u8").view(np.uint8).reshape(n, 8)
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, n, 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(h[a : a + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3, seed: int = 42, mark: Column | None = None) -> DataFrame:
    """id and the fingerprint (a long) of each row, and its mark (a string) where one is given."""
    marked = mark is not None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            # bytes.lower and bytes.split go by A-Z and the six ASCII spaces only
            found = [_bits_of(bytes(t).lower().split(), width, seed) for t in raw_texts(part.column("text"))]
            own = {"id": part.column("id"), "fingerprint": pa.array(np.array(found, dtype=np.uint64).astype(np.int64))}
            if marked:
                own["mark"] = part.column("mark")
            yield pa.record_batch(list(own.values()), names=list(own))

    rows = docs.select(id_key(id_column).alias("id"), whole(text_column).alias("text"), *([mark.alias("mark")] if marked else []))
    return rows.mapInArrow(work, "id long, fingerprint long" + (", mark string" if marked else ""))


def _forest(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """Indices of links (a, b) that connect the same nodes as all of them: a spanning forest."""
    root = np.arange(nodes)
    chosen = []
    while True:
        ra, rb = root[a], root[b]
        open_ = np.flatnonzero(ra != rb)
        if not len(open_):
            return np.concatenate(chosen) if chosen else np.zeros(0, dtype=np.int64)
        high, low = np.maximum(ra[open_], rb[open_]), np.minimum(ra[open_], rb[open_])
        heads, pick = np.unique(high, return_index=True)  # each tree hangs itself once under a smaller one: no cycles
        root[heads] = low[pick]
        chosen.append(open_[pick])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _compare(radius: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            for left, right, same in zip(batch.column("left"), batch.column("right"), batch.column("same").to_pylist()):
                x, y = (np.asarray(side.values).view(np.uint64) for side in (left, right))
                found_a, found_b = [], []
                for at in range(0, len(x), 512):  # a block of 512 x TILE differences at a time
                    near = np.bitwise_count(x[at : at + 512, None] ^ y[None, :]) <= radius
                    i, j = np.nonzero(near)
                    i += at
                    if same:
                        i, j = i[i < j], j[i < j]
                    kept = _forest(i, j + len(x), len(x) + len(y)) if not same else _forest(i, j, len(x))
                    found_a.append(i[kept])
                    found_b.append(j[kept])
                i, j = np.concatenate(found_a), np.concatenate(found_b)
                kept = _forest(i, j + len(x), len(x) + len(y)) if not same else _forest(i, j, len(x))
                out_a.append(x[i[kept]].view(np.int64))
                out_b.append(y[j[kept]].view(np.int64))
            if out_a:
                yield pa.record_batch([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

    return compare


def _offsets(radius: int) -> list[tuple[int, ...]]:
    """Differences of the quarter counts within ``radius``, one of each opposite two."""
    found = [()]
    for _ in range(_QUARTERS):
        found = [(*f, d) for f in found for d in range(-radius, radius + 1) if sum(map(abs, f)) + abs(d) <= radius]
    return [f for f in found if f >= (0,) * _QUARTERS]


def links(different: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """Links (a, b) between different fingerprints at ``radius`` bits or fewer, as spanning forests of tile pairs."""
    quarter = 64 // _QUARTERS
    counts = [F.bit_count(F.shiftrightunsigned("fingerprint", quarter * k).bitwiseAND((1 << quarter) - 1)) for k in range(_QUARTERS)]
    base = 32
    cell = sum((c * base**k for k, c in enumerate(counts[::-1])), F.lit(0)).cast("int")
    celled = different.select("fingerprint", cell.alias("cell"))
    sizes = celled.groupBy("cell").agg(F.count("*").alias("n")).withColumn("cuts", F.ceil(F.col("n") / tile).cast("int"))
    tiles = celled.join(sizes, "cell").withColumn("cut", F.pmod(F.xxhash64("fingerprint"), F.col("cuts")).cast("int"))
    tiles = written(tiles.groupBy("cell", "cut").agg(F.collect_list("fingerprint").alias("members")), "simhash-tiles")
    names = tiles.select("cell", "cut")
    shifts = [sum(d * base ** (_QUARTERS - 1 - k) for k, d in enumerate(o)) for o in _offsets(radius)]
    near = names.select(F.col("cell").alias("cell_a"), F.col("cut").alias("cut_a"), F.explode(F.array(*[F.col("cell") + s for s in shifts])).alias("cell"))
    # counts go from 0 to 16, so a sum of shifted digits names a neighbour only if no digit was carried
    near = near.join(names, "cell").where((F.col("cell") != F.col("cell_a")) | (F.col("cut") >= F.col("cut_a")))
    near = near.select("cell_a", "cut_a", F.col("cell").alias("cell_b"), F.col("cut").alias("cut_b"))
    left = tiles.select(F.col("cell").alias("cell_a"), F.col("cut").alias("cut_a"), F.col("members").alias("left"))
    right = tiles.select(F.col("cell").alias("cell_b"), F.col("cut").alias("cut_b"), F.col("members").alias("right"))
    same = (F.col("cell_a") == F.col("cell_b")) & (F.col("cut_a") == F.col("cut_b"))
    pairs = near.join(left, ["cell_a", "cut_a"]).join(right, ["cell_b", "cut_b"]).select("left", "right", same.alias("same"))
    return pairs.mapInArrow(_compare(radius), "a long, b long")


def _placed(marks: DataFrame, first: Column, radius: int) -> DataFrame:
    """Each different fingerprint with the root of its group and the smallest ``first`` of its rows."""
    different = marks.groupBy("fingerprint").agg(F.min(first).alias("first"))
    roots = smallest_reachable(links(different.select("fingerprint"), radius))
    return different.join(roots, different.fingerprint == roots.node, "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))


def groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable."""
    marks = written(fingerprints(docs, id_column, text_column, width, seed), "simhash-fingerprints")
    placed = _placed(marks, F.col("id"), radius)
    smallest = placed.groupBy("root").agg(F.min("first").alias("component"))
    named = placed.join(smallest, "root").select("fingerprint", "component")
    null = lambda c: F.nullif(F.col(c), F.lit(NULL_ID))
    return marks.join(named, "fingerprint").select(
        null("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), null("component").alias("component_id")
    )


def survivors(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """The one row of each group that stays: of the smallest id, null first, and of rows of that id the smallest by hash.

    Rows are told apart by a hash of all their columns, so neither a null id nor one that several rows share loses a group
    or keeps two rows of one; wholly repeated rows stay once.
    """
    cells = [F.md5(F.col(c).cast("string")).alias(f"c{k}") for k, c in enumerate(docs.columns)]
    mark = F.md5(F.to_json(F.struct(*cells)))  # a null cell has no field
    marks = written(fingerprints(docs, id_column, text_column, width, seed, mark), "simhash-marks")
    placed = _placed(marks, F.struct("id", "mark"), radius)
    chosen = placed.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.mark").alias("__mark"))
    return docs.withColumn("__mark", mark).join(chosen, "__mark", "left_semi").dropDuplicates(["__mark"]).select(*docs.columns)
