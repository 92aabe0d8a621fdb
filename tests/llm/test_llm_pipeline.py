"""The corpus pipeline, stage by stage against plain versions, and the registered queries."""

import hashlib
import inspect
from collections import Counter

import public_tokenizers as public
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from test_llm_line_dedup import brute as line_brute
from test_llm_simhash import brute as mark_brute
from weaklabel.llm import bpe, mixing, toxicity
from weaklabel.llm.line_dedup import MIN_CHARS


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def stages(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], folder).cache())
    yield folder, out
    for df in out:
        df.unpersist()


def test_columns_and_order(stages):
    _, out = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "mixing", "byte_bpe"]
    assert all(df.columns == corpus_pipeline.COLUMNS for df in out[:-1])


def test_toxicity_stage(spark, stages):
    folder, out = stages
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(~toxicity.held_out("doc_id"))
    grammar = toxicity.learn(out[0], labels)
    want = sorted(tuple(r) for r in out[0].collect() if grammar.probability(grammar.matches(r.text)) < 0.7)
    assert sorted(tuple(r) for r in out[1].collect()) == want and len(want) < out[0].count()


def test_line_stage(stages):
    _, out = stages
    before, after = {r.doc_id: r for r in out[1].collect()}, {r.doc_id: r for r in out[2].collect()}
    gone = line_brute([(i, r.text) for i, r in before.items()], MIN_CHARS)
    assert set(before) == set(after)
    for i, r in before.items():
        kept = "\n".join(s for k, s in enumerate(r.text.split("\n"), 1) if k not in gone[i])
        assert after[i].text == kept and after[i].n_chars == (len(kept) if gone[i] else r.n_chars)


def test_simhash_stage(stages):
    _, out = stages
    groups = mark_brute([(r.doc_id, r.text) for r in out[2].collect()])
    assert rows_of(out[3]) == sorted((tuple(r) for r in out[2].collect() if groups[r.doc_id][1] == r.doc_id), key=str)


def test_simhash_stage_keeps_one_row_of_each_group_whatever_its_id(spark):
    one, two, three, four = ("".join(f"{w}{k} " for k in range(40)) for w in ("ash", "birch", "cedar", "dogwood"))
    rows = [
        (None, one), (4, one), (5, one),  # the null id is the smallest
        (7, two), (7, two), (8, two),  # repeated rows
        (7, three), (9, three),  # an id that is also another group's head
        (None, four),
        (None, ""), (1, "  "), (2, None), (3, ""),  # no words
    ]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == corpus_pipeline.COLUMNS
    assert rows_of(got.select("doc_id", "text")) == sorted([(None, one), (7, two), (7, three), (None, four), (None, "")], key=str)
    # two texts of one id within one group: one stays
    twice = spark.createDataFrame([(1, one, "en", "web", 1), (1, one.upper(), "en", "web", 1), (2, one, "en", "web", 1)], docs.schema)
    assert [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, twice, "").collect()] == [1]


def test_mixing_stage(stages):
    _, out = stages
    times = Counter()
    for r in mixing.mix(out[3], ["doc_id"]).collect():
        times[r.doc_id] += int(r.taken / r.size + 0.5) if r.size else 0
    assert Counter(r.doc_id for r in out[4].collect()) == Counter({i: n for i, n in times.items() if n})


def test_encoding_stage(stages):
    _, out = stages
    texts = {r.doc_id: r.text for r in out[4].collect()}
    for r in out[5].collect():
        (ids,) = bpe.encode([texts[r.doc_id]], public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_is_the_stages_in_turn(spark, stages):
    folder, out = stages
    assert rows_of(corpus_pipeline.run(spark, folder)) == rows_of(out[5])


def test_one_query_for_each_operator():
    names = entry_points.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))


@pytest.mark.parametrize("module", ["chat", "line_dedup", "mixing"])
def test_native_operators_hold_no_python_functions_for_tasks(module):
    source = inspect.getsource(__import__(f"weaklabel.llm.{module}", fromlist=["x"]))
    assert not any(w in source for w in ("udf", "mapIn", "applyIn", ".rdd", "pandas", "pyarrow"))
