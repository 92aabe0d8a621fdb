"""Edit fingerprints against a plain walk, and what they say about edits."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weaklabel.llm import edit_fingerprint as ef
from weaklabel.llm.edit_fingerprint import fingerprints, fingerprints_of, likeness, near_classes, sampled_steps, with_next

SCHEMA = "doc_id long, text string"


def plain(text):
    """One walk, step by step."""
    symbols = [*ef.symbols_of(text).tolist(), 255]
    p, out, octave = 0, [], 0
    while True:
        picks = set(sampled_steps(octave))
        for step in range(1 << octave, 2 << octave):
            if step in picks:
                out.append("0123456789abcdef"[ef._CODES[symbols[p]]])
            p += int(ef._MOVES[step % ef._PERIOD, symbols[p]])
        octave += 1
        if p == len(symbols) - 1:
            return "".join(out)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=300), min_size=1, max_size=5))
def test_walks_alone(texts):
    assert fingerprints_of(texts) == [plain(t) for t in texts]


def test_walks_side_by_side():
    draw = random.Random(1)
    texts = ["".join(draw.choice("abcdé zß日") for _ in range(draw.choice([0, 1, 2, 5, 31, 64, 200, 1500, 9000]))) for _ in range(150)]
    assert fingerprints_of(texts) == [plain(t) for t in texts]


def test_likeness_falls_with_edits():
    draw = random.Random(2)
    means = []
    for edits in (2, 40, 600):
        found = []
        for _ in range(12):
            text = "".join(draw.choice("etaoin shrdlu") for _ in range(3000))
            chars = list(text)
            for _ in range(edits):
                at = draw.randrange(len(chars))
                chars[at : at + draw.randint(0, 1)] = draw.choice(["", "x", "yz"])
            found.append(likeness(*fingerprints_of([text, "".join(chars)])))
        means.append(sum(found) / len(found))
    a, b = fingerprints_of(["".join(draw.choice("etaoin shrdlu") for _ in range(3000)) for _ in range(2)])
    assert 1 > means[0] > means[1] > means[2] > likeness(a, b) - 0.05 and means[0] > 0.75
    assert likeness(a, a) == 1.0 and likeness("", "0") == 1.0


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1] or ""
        t = t or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + following[:n]
        a, b, c = fingerprints_of([t, edited, following])
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, likeness(a, b), likeness(a, c))
    return out


@pytest.mark.parametrize("parts", [1, 5, 64])
def test_whole_table(spark, tiny, parts):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").where("length(text) < 4000")
    got = {r.doc_id: tuple(r)[1:] for r in with_next(docs, parts=parts).collect()}
    assert got == expected([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r[4] > r[5] for r in got.values()) > 0.95 * len(got)


def test_defined_cases(spark):
    rows = [(5, "five five five"), (None, "none"), (3, None), (9, ""), (7, "日本語のテキスト" * 9)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int")
    for parts in (1, 3):
        assert {r.doc_id: tuple(r)[1:] for r in with_next(frame, parts=parts).collect()} == expected(rows)
    assert with_next(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = with_next(spark.createDataFrame([(1, "abcabc")], SCHEMA)).collect()
    assert [r.near_next for r in alone] == [1.0]
    same = with_next(spark.createDataFrame([(1, "abcabc"), (1, "abcabc"), (2, "x")], SCHEMA), parts=2).collect()
    assert sorted(r.doc_id for r in same) == [1, 1, 2]


def classes(spark, rows, **options):
    marks = fingerprints(spark.createDataFrame(rows, SCHEMA), ["doc_id"])
    named = marks.select("doc_id", *ef.mark_hashes()).join(near_classes(marks.withColumnRenamed("doc_id", "id"), **options), ["h", "g"])
    return {r.doc_id: r.class_id for r in named.collect()}


def near_pairs(rows, least=0.8):
    marks = fingerprints_of([t for _, t in rows])
    return [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if likeness(marks[i], marks[j]) >= least]


@pytest.mark.parametrize("tile", [512, 7])
def test_near_classes_hold_copies_and_near_copies(spark, tile):
    draw = random.Random(3)
    base = ["".join(draw.choice("etaoin shrdlu") for _ in range(2000)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t[:1990] + "0123456789") for i, t in enumerate(base)] + [(200, base[0]), (201, base[0])]
    found = classes(spark, rows, tile=tile)
    assert found == {i: 0 if i >= 200 else i % 100 for i, _ in rows}


@pytest.mark.parametrize("shared", ["nothing", "beginning", "end"])
def test_near_pairs_are_found(spark, shared):
    """Also among many documents that share a half, where every band of that half holds them all."""
    draw = random.Random(5)
    half = "".join(draw.choice("etaoin shrdlu") for _ in range(1500))
    rows = []
    for i in range(120):
        own = "".join(draw.choice("etaoin shrdlu") for _ in range(1500 if shared != "nothing" else 3000))
        text = {"nothing": own, "beginning": half + own, "end": own + half}[shared]
        chars = list(text)
        for _ in range(draw.choice([1, 2, 6])):
            chars[draw.randrange(len(chars))] = draw.choice(["", "x", "yz"])
        rows += [(2 * i, text), (2 * i + 1, "".join(chars))]
    pairs = near_pairs(rows)
    found = classes(spark, rows)
    assert len(pairs) >= 30
    assert sum(found[a] == found[b] for a, b in pairs) >= 0.9 * len(pairs)
    # classes are what links join, so members of one that are not near each other need a chain of near ones
    linked = {frozenset(p) for p in pairs}
    for c in set(found.values()):
        members = [i for i, k in found.items() if k == c]
        assert len(members) == 1 or all(any(frozenset((a, b)) in linked for b in members if b != a) for a in members)


def test_likenesses_are_those_of_pairs():
    draw = random.Random(7)
    texts = ["".join(draw.choice("ab c") for _ in range(draw.choice([0, 1, 30, 700]))) for _ in range(25)]
    marks = fingerprints_of([*texts, texts[3] + "x"])
    found = ef.likenesses(marks, marks[:9])
    for i, a in enumerate(marks):
        for j, b in enumerate(marks[:9]):
            assert found[i, j] == pytest.approx(likeness(a, b))


def test_classes_of_odd_rows(spark):
    rows = [(None, "abc"), (4, "abc"), (4, "other text entirely, long enough"), (5, None), (6, ""), (6, "")]
    out = ef.with_classes(with_next(spark.createDataFrame(rows, SCHEMA))).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in out) == [("4", "4"), ("4", "None"), ("5", "5"), ("6", "5"), ("6", "5"), ("None", "None")]
    assert ef.with_classes(with_next(spark.createDataFrame([], SCHEMA))).count() == 0
