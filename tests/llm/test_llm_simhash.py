"""SimHash fingerprints, links and groups against brute force."""

import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weaklabel.llm.common import smallest_reachable
from weaklabel.llm.simhash import _bits_of, _forest, groups, links


def mark_of(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def roots_of(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows):
    marks = {i: mark_of(t) for i, t in rows}
    near = [(a, b) for a in marks for b in marks if a < b and (marks[a] ^ marks[b]).bit_count() <= 3]
    root = roots_of(marks, near)
    return {i: (f"{m:016x}", root[i]) for i, m in marks.items()}


def test_whole_table(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in groups(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_spark_hashes_agree(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first()
    assert row.h % 2**64 == _bits_of([b"a", b"b", b"c"], 3, 42)


@settings(max_examples=50, deadline=None)
@given(st.integers(2, 30), st.data())
def test_forest_keeps_connections(n, data):
    pairs = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)), max_size=60))
    pairs = [p for p in pairs if p[0] != p[1]]
    a, b = np.array([p[0] for p in pairs], dtype=np.int64), np.array([p[1] for p in pairs], dtype=np.int64)
    kept = _forest(a, b, n)
    assert len(kept) < n
    assert roots_of(range(n), pairs) == roots_of(range(n), [pairs[i] for i in kept])


@pytest.mark.parametrize("tile", [3, 4096])
def test_links_of_clusters_and_chains(spark, tile):
    draw = np.random.default_rng(1)
    marks = set(draw.integers(0, 2**63, 40).tolist())
    for m in list(marks)[:10]:  # clusters round a centre, and chains that leave it
        for _ in range(12):
            m2 = m
            for b in draw.integers(0, 63, 2).tolist():
                m2 ^= 1 << b
            marks.add(m2)
            m = m2 if draw.random() < 0.5 else m
    marks |= {0, 7, 1, 2**62}
    frame = spark.createDataFrame([(m,) for m in marks], "fingerprint long")
    near = [(a, b) for a in marks for b in marks if a < b and (a ^ b).bit_count() <= 3]
    got = [(r.a, r.b) for r in links(frame, 3, tile).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in got)
    assert roots_of(marks, got) == roots_of(marks, near)
    found = {r.node: r.root for r in smallest_reachable(links(frame, 3, tile)).collect()}
    assert {m: found.get(m, m) for m in marks} == roots_of(marks, near)


def test_components_of_a_long_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5)]
    got = {r.node: r.root for r in smallest_reachable(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}


def test_defined_cases(spark):
    rows = [(5, None, 1), (3, "", 1), (4, " \n", 1), (8, "One two", 1), (9, "one TWO", 1), (9, "one TWO", 1), (None, "alone here now", 1)]
    got = groups(spark.createDataFrame(rows, "doc_id long, text string, fingerprint long")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (3, 3), (4, 3), (5, 3), (8, 8), (9, 8), (9, 8)]
    assert {r.fingerprint for r in got if r.component_id == 3} == {"0" * 16}
    assert groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
