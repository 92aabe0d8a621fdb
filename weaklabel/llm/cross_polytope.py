"""Embedding near-dedup by cross-polytope hashing.

A hash function turns a vector three times by random signs and a fast Hadamard transform (vectors are filled up with zeros
to a power of two) and names the nearest corner of the cross-polytope: the largest coordinate and its sign. A table's key
joins the corners of a few functions, as many as make the keys of a table outnumber the vectors (``functions_for``). Every
vector lies in its own bucket of each table and probes the keys that small moves would have led to, the least first; a pair is found where one of both lies in a bucket that the other probes.

Only ids and keys are shuffled first, and probes of buckets in which nothing lies end there. Then the vectors that are left
meet in their buckets. A bucket is cut into tiles of about ``TILE`` rows, lying against probing, so that the copies of one
text, were they a third of all rows, are many tasks; a tile is one matrix product, and each pair with a cosine of at least
``least`` counts in exactly one tile: that of the first table in which it is found, where the vector of the smaller number
lies if the other probes there, else where the other lies. A tile hands on a number of links for each of its vectors and a
spanning forest of its links, never its pairs. Groups are connected components.

Equal vectors are one first, with their number; they link with each other.

Recall of pairs at a cosine of just 0.9, 64 components, simulated: 0.99 (two functions), 0.97 (three); at 0.95 over 0.999.

Cost: the rows of a dense group compare with each other, which counting their links takes; all else is a few keys a vector.

Defined cases: vectors that are null, all zero, or hold a null or non-finite component link with nothing and come back with
0 links as their own component; vectors of different length are never linked; a null id is the smallest and comes back as
null; a repeated row is a vector of its own that links with its copies; one id with two vectors is two vectors; an empty
table gives an empty result; other columns are ignored. Squares neither overflow nor vanish: vectors are scaled by a power
of two first, which changes no cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weaklabel.llm.ann import usable
from weaklabel.llm.common import NULL_ID, id_key, smallest_reachable, written
from weaklabel.llm.simhash import _forest

TILE = 1024
_BATCH = 2048


def functions_for(rows: int, dimension: int) -> int:
    """How many functions make a table's keys outnumber ``rows`` vectors four times."""
    corners = 2 * max(2, 1 << (dimension - 1).bit_length())
    return max(1, math.ceil(math.log(max(4 * rows, 2)) / math.log(corners)))


def tables_for(functions: int) -> int:
    """More functions miss more: their tables grow too."""
    return max(2, functions - 1)


def probes_for(functions: int) -> int:
    """How many keys a vector looks at in a table, its own among them."""
    return 8 if functions == 1 else 16 << (functions - 1)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, of a power of two columns, keeping lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        pairs = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def rotate(x: np.ndarray, seed: tuple[int, ...]) -> np.ndarray:
    """A pseudo-random rotation: three times random signs and a Hadamard transform."""
    draw = np.random.default_rng(seed)
    for _ in range(3):
        x = hadamard(x * draw.choice([-1.0, 1.0], x.shape[1]))
    return x


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows over the power of two next to their largest component."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def keys(x: np.ndarray, table: int, functions: int, probes: int, seed: int) -> np.ndarray:
    """The keys that each row of ``x`` lies in (first) and probes in one table, the likeliest first."""
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    full = np.zeros((n, width))
    full[:, :d] = x / np.sqrt((x * x).sum(axis=1))[:, None]
    few = min(8, 2 * width)
    cost, key = np.zeros((n, 1)), np.full((n, 1), d * 64 + table, dtype=np.uint64)
    for f in range(functions):
        turned = rotate(full, (seed, d, table, f))
        corners = np.concatenate([turned, -turned], axis=1)
        top = np.argpartition(-corners, few - 1, axis=1)[:, :few]
        near = np.take_along_axis(corners, top, axis=1)
        order = np.lexsort((top, -near), axis=1)
        top, near = np.take_along_axis(top, order, axis=1), np.take_along_axis(near, order, axis=1)
        cost = (cost[:, :, None] + ((near[:, :1] - near) ** 2)[:, None, :]).reshape(n, -1)
        key = (key[:, :, None] * np.uint64(2 * width + 1) + top.astype(np.uint64)[:, None, :]).reshape(n, -1)
        order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        cost, key = np.take_along_axis(cost, order, axis=1), np.take_along_axis(key, order, axis=1)
    return key.view(np.int64)


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and doubles of the rows of each length."""
    vectors = batch.column("vector")
    sizes = np.diff(np.asarray(vectors.offsets))
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        yield rows, scaled(np.asarray(vectors.take(pa.array(rows)).flatten()).astype(np.float64).reshape(-1, d))


def _places(tables: int, functions: int, probes: int, seed: int, lying: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, _BATCH):
                batch = whole_batch.slice(at, _BATCH)
                nodes = np.asarray(batch.column("node"))
                for rows, x in _matrices(batch):
                    for t in range(tables):
                        found = keys(x, t, functions, probes, seed)
                        own = found[:, :1] if lying else found[:, 1:]
                        yield pa.record_batch([pa.array(own.ravel()), pa.array(np.repeat(nodes[rows], own.shape[1]))], names=["key", "node"])

    return work


def _first_here(x: np.ndarray, left: np.ndarray, right: np.ndarray, nodes: np.ndarray, key: int, tables: int, functions: int, probes: int, seed: int) -> np.ndarray:
    """Which of the pairs (rows of a tile: lying, probing) count here: ``key`` is the first place where they are found."""
    held, where = np.unique(np.concatenate([left, right]), return_inverse=True)
    left, right, nodes = where[: len(left)], where[len(left) :], nodes[held]
    here = np.zeros(len(left), dtype=bool)
    found_before = np.zeros(len(left), dtype=bool)
    for t in range(tables):
        own = keys(x[held], t, functions, probes, seed)
        mains, of = np.unique(own[:, 0], return_inverse=True)
        reach = np.zeros((len(held), len(mains)), dtype=bool)  # which of the buckets in play each row probes or lies in
        for m, main in enumerate(mains):
            reach[:, m] = (own == main).any(axis=1)
        low, high = np.where(nodes[left] < nodes[right], left, right), np.where(nodes[left] < nodes[right], right, left)
        at_low, at_high = reach[high, of[low]], reach[low, of[high]]
        if (mains == key).any():
            spot = np.where(at_low, own[low, 0], own[high, 0])
            # of a pair that lies in one bucket, only the order of its numbers counts
            here = (spot == key) & (own[left, 0] == key) & ((own[left, 0] != own[right, 0]) | (left == low)) & ~found_before
            return here
        found_before |= at_low | at_high
    return here


def _tiles(least: float, tables: int, functions: int, probes: int, seed: int):
    def compare(key: int, role: np.ndarray, nodes: np.ndarray, copies: np.ndarray, x: np.ndarray, out: list) -> None:
        lying, probing = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        if not len(lying) or not len(probing):
            return
        x = scaled(x.astype(np.float64))
        length = np.sqrt((x * x).sum(axis=1))
        lefts, rights = [], []
        for at in range(0, len(lying), 256):
            a = lying[at : at + 256]
            cosine = (x[a] @ x[probing].T) / (length[a, None] * length[None, probing])
            i, j = np.nonzero((cosine >= least) & (nodes[a, None] != nodes[None, probing]))
            if len(i):
                i, j = a[i], probing[j]
                own = _first_here(x, i, j, nodes, key, tables, functions, probes, seed)
                lefts.append(i[own])
                rights.append(j[own])
        if not lefts:
            return
        i, j = np.concatenate(lefts), np.concatenate(rights)
        added = np.zeros(len(nodes), dtype=np.int64)
        np.add.at(added, i, copies[j])
        np.add.at(added, j, copies[i])
        held, kept = np.flatnonzero(added), _forest(i, j, len(nodes))
        out.append((nodes[held], nodes[held], added[held]))
        out.append((nodes[i[kept]], nodes[j[kept]], np.zeros(len(kept), dtype=np.int64)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tiles_of(table: pa.Table, last: bool, out: list) -> pa.Table:
            """Compare the tiles of sorted rows; the last tile may go on in the next batch and is given back."""
            names = np.stack([np.asarray(table.column(c)) for c in ("key", "lie", "probe")])
            cuts = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1).tolist()]
            if last:
                cuts.append(table.num_rows)
            role, nodes, copies = (np.asarray(table.column(c)) for c in ("role", "node", "copies"))
            vectors = table.column("vector").combine_chunks()
            offsets, values = np.asarray(vectors.offsets), np.asarray(vectors.values)
            for a, b in zip(cuts, cuts[1:]):
                compare(int(names[0, a]), role[a:b], nodes[a:b], copies[a:b], values[offsets[a] : offsets[b]].reshape(b - a, -1), out)
            return table.slice(cuts[-1])

        def sent(out: list) -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.record_batch([pa.array(np.concatenate([o[c] for o in out])) for c in range(3)], names=["a", "b", "n"])

        rest = None
        for batch in batches:
            if batch.num_rows:
                table, out = pa.Table.from_batches([batch]), []
                rest = tiles_of(table if rest is None else pa.concat_tables([rest, table]), False, out)
                yield from sent(out)
        if rest is not None:
            out = []
            tiles_of(rest, True, out)
            yield from sent(out)

    return work


def near_copies(
    vectors: DataFrame, least: float = 0.9, tables: int | None = None, tile: int = TILE, seed: int = 11, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors``."""
    vector = F.col(vector_column)
    rows = vectors.select(id_key(id_column).alias("id"), vector.alias("vector"), usable(vector).alias("good"))
    marks = [F.xxhash64("vector").alias("h"), F.xxhash64(F.lit(seed), "vector").alias("g")]
    good = rows.where("good")
    classes = good.groupBy(*marks).agg(F.first("vector").alias("vector"), F.min("id").alias("first"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "polytope-vectors")
    total, dimension = classes.agg(F.count("*"), F.max(F.size("vector"))).first()
    functions = functions_for(total, dimension or 1)
    probes, tables = probes_for(functions), tables or tables_for(functions)
    place = lambda lying: classes.select("node", "vector").mapInArrow(_places(tables, functions, probes, seed, lying), "key long, node long")
    lying = place(True)
    # probes of empty buckets end here, before any vector moves
    probing = place(False).join(lying.select("key").distinct(), "key", "left_semi")
    held = written(lying.withColumn("lies", F.lit(1)).unionByName(probing.withColumn("lies", F.lit(0))), "polytope-places")
    sizes = held.groupBy("key").agg(F.sum("lies").alias("n_lying"), F.count("*").alias("n")).where("n > 1")
    cut = lambda n: F.ceil(F.col(n) / tile).cast("int")
    # a written table, so that Spark can split the rows of a bucket that very many vectors lie in or probe
    sizes = written(sizes.select("key", cut("n_lying").alias("lie_cuts"), cut("n").alias("probe_cuts")), "polytope-sizes")
    lie, probe = F.pmod(F.xxhash64("node"), F.col("lie_cuts")).cast("int"), F.pmod(F.xxhash64(F.lit(2), "node"), F.col("probe_cuts")).cast("int")
    spot = lambda a, b, role: F.struct(a.cast("int").alias("lie"), b.cast("int").alias("probe"), role.cast("int").alias("role"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # role 1: lies here, role 2: is compared with what lies here; both where a row's own two cuts meet
    compared = F.transform(every("lie_cuts"), lambda m: spot(m, F.col("probe"), F.when((F.col("lies") == 1) & (m == F.col("lie")), 3).otherwise(2)))
    against = F.filter(F.transform(every("probe_cuts"), lambda q: spot(F.col("lie"), q, F.lit(1))), lambda s: (F.col("lies") == 1) & (s["probe"] != F.col("probe")))
    dealt = held.join(sizes, "key").withColumn("lie", lie).withColumn("probe", probe)
    dealt = dealt.select("key", "node", F.explode(F.concat(compared, against)).alias("s")).select("key", "node", "s.*")
    tiles = dealt.join(classes.select("node", "vector", F.col("copies").alias("copies")), "node")
    tiles = tiles.repartition("key", "lie", "probe").sortWithinPartitions("key", "lie", "probe")
    found = tiles.select("key", "lie", "probe", "role", "node", "copies", "vector").mapInArrow(_tiles(least, tables, functions, probes, seed), "a long, b long, n long")
    found = written(found, "polytope-links")
    counts = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = smallest_reachable(found.where("a <> b").select("a", "b"))
    placed = classes.select("h", "g", "node", "first", "copies").join(counts, "node", "left").join(roots, "node", "left")
    placed = placed.withColumn("root", F.coalesce("root", "node"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component"))
    links = (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    named = placed.join(smallest, "root").select("h", "g", links, "component")
    linked = good.select("id", *marks).join(named, ["h", "g"]).select("id", "n_links", "component")
    alone = rows.where(~F.col("good")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    null = lambda c: F.nullif(F.col(c), F.lit(NULL_ID))
    return linked.unionByName(alone).select(null("id").alias("vec_id"), "n_links", null("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
