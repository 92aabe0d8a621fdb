"""Substring dedup against brute force."""

import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from weaklabel.llm.substring_dedup import remove_repeated, repeated_spans

SCHEMA = "doc_id long, text string"


def brute(rows, window=20):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(words, key=lambda x: (x is not None, x)):
        for s in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][s : s + window]), (i, s))
    out = {}
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] != (i, s):
                gone |= set(range(s, s + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def ours(frame, **more):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeated(frame, **more).collect()}


def test_whole_table(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert ours(docs, with_text=False) == brute(rows)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n\té", max_size=60), min_size=1, max_size=12))
def test_short_windows_over_few_words(spark, texts):
    rows = list(enumerate(texts))
    assert ours(spark.createDataFrame(rows, SCHEMA).repartition(3), window=4, minimiser=2) == brute(rows, 4)


def test_defined_cases(spark):
    long = " ".join(f"w{i % 977}" for i in range(50_000))
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, None), (2, ""), (3, long), (4, f"before {passage}\vafter"), (5, f"\x0b{passage} then"), (None, passage), (6, " \t\n")]
    found = ours(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert found == brute(rows)
    assert found[4][1] == 30 and found[5][1] == 30 and found[None][1] == 0  # a null id is the smallest


def test_repeated_rows_are_one_document(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(7, passage)] * 5 + [(9, passage)]
    got = remove_repeated(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(7, 0)] * 5 + [(9, 25)]
    assert {r.kept_text for r in got if r.doc_id == 9} == {""}


def test_empty_table_and_clashing_columns(spark):
    assert remove_repeated(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([(1, "a b", 5, 6)], "doc_id long, text string, id long, mark long")
    assert remove_repeated(odd).collect()[0].kept_text == "a b"


@pytest.mark.parametrize("bucket_bytes", [200, 8 << 20])
def test_a_passage_that_many_share_and_many_buckets(spark, bucket_bytes):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"{' '.join(f'u{i}x{k}' for k in range(15))} {passage} tail{i} " + " ".join(f"v{i}x{k}" for k in range(15))) for i in range(300)]
    spans = repeated_spans(spark.createDataFrame(rows, SCHEMA).repartition(5), bucket_bytes=bucket_bytes).collect()
    gone = {}
    for s in spans:
        gone.setdefault(s.id, set()).update(range(s.begin, s.stop))
    assert set(gone) == set(range(1, 300)) and all(v == set(range(15, 55)) for v in gone.values())
