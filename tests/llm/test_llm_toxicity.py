"""The toxicity grammar: its machine, its learning, and accuracy on held-out rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weaklabel.llm import toxicity
from weaklabel.llm.toxicity import KINDS, Grammar, held_out, learn, score, terms_of


def kinds(text, **more):
    g = Grammar({"fool": 2.0}, {"nastw": 3.0}, **more)
    return {k: v for k, v in zip(KINDS, g.matches(text)) if v}


def test_the_state_of_a_match():
    assert kinds("what a fool") == {"insult": 2.0}
    assert kinds("you are a FOOL, friend") == {"insult_targeted": 2.0}
    assert kinds("you are not a fool") == {"insult_negated": 2.0}
    assert kinds("he said what a big fool") == {"insult_reported": 2.0}
    assert kinds("you. a fool") == {"insult": 2.0}  # clauses end at stops
    assert kinds("not at all the case here but a fool") == {"insult": 2.0}  # out of reach of the negation
    assert kinds("a nastwort and NASTWERK") == {"insult": 6.0}
    assert kinds("i will hurt you") == {"threat_targeted": 1.0}
    assert kinds("it may hurt") == {"threat": 1.0}
    assert kinds("") == {} == kinds("foolish things. nothing else")


def test_weights_order_the_states():
    g = Grammar({"fool": 2.0})
    p = lambda text: g.probability(g.matches(text))
    assert p("you are a fool") > p("a fool") > p("he wrote: a") and p("a fool") > p("you are not a fool") > p("nothing")
    assert 0 < p("") < p("a fool, you fool, a fool") <= 1


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    grammar = learn(docs, labels.where(~held_out("doc_id")))
    return {r.doc_id: r for r in score(docs.withColumn("out", held_out("doc_id")), grammar, ["doc_id", "out"]).collect()}, {r.doc_id: r.toxic for r in labels.collect()}


def test_held_out_accuracy(scored):
    rows, labels = scored
    out = [(rows[i].predicted, y) for i, y in labels.items() if rows[i].out]
    assert {i for i in rows if rows[i].out} == {i for i in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    caught = sum(p and y for p, y in out) / sum(y for _, y in out)
    right = sum(p and y for p, y in out) / max(1, sum(p for p, _ in out))
    assert caught > 0.85 and right > 0.95  # some toxic rows of this table hold no word of their kind at all


def test_scores_are_probabilities(scored):
    rows, _ = scored
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows.values())


def test_labels_held_out_are_never_used(spark):
    rows = [(i, "zzbad words here" if i % 2 else "plain words here") for i in range(400)]
    labels = [(i, i % 2) for i in range(400)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    first = learn(docs, known.where(~held_out("doc_id")))
    flipped = known.withColumn("toxic", F.when(held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    second = learn(docs, flipped.where(~held_out("doc_id")))
    assert first.words == second.words and first.bias == second.bias and np.array_equal(first.weights, second.weights)
    assert "zzbad" in first.words or any("zzbad".startswith(b) for b in first.beginnings)
    got = score(docs, first, ["doc_id"]).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got)


def test_repeats_count_only_where_different_texts_show_nothing(spark):
    names = [a + b for a in "bcdfghkl" for b in "aeiou"]
    bad, good = [f"zzbad {n} here" for n in names], [f"plain {n} here" for n in names]
    copies = ["grumble words here"] * 60
    texts = [(t, 1) for t in bad + copies] + [(t, 0) for t in good]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int")
    both = learn(docs, labels)
    assert set(both.words) == {"zzbad"} and not both.beginnings
    alone = learn(docs.where("text not like 'zzbad%'"), labels)
    assert "grumble" in alone.words and not any(w.startswith(("plain", "here")) for w in [*alone.words, *alone.beginnings])


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, 3.0), (None, "", 3.0), (2, "a " * 100_000, 3.0), (2, "b", 3.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    grammar = learn(docs, none)
    got = score(docs, grammar, ["doc_id"]).collect()
    assert len(got) == 4 and {r.predicted for r in got} == {0} and len({r.score for r in got}) == 1
    twice = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    assert 0 < score(docs, learn(docs, twice), ["doc_id"]).first().score < 1
    assert score(spark.createDataFrame([], docs.schema), grammar, ["doc_id"]).count() == 0
    assert terms_of("Abcdefg ab") == {"abcdefg", "abcd*", "abcde*", "abcdef*"}
    assert toxicity.REACH == 3


def plain_read(clause, sums):
    """A clause word by word, without tables."""
    from weaklabel.llm import toxicity as t

    denied, reported = 0, False
    targets = [i for i, (s, _) in enumerate(clause) if s == "t"]
    for i, (s, weight) in enumerate(clause):
        if s in ("i", "x"):
            how = 2 if denied else 3 if reported else 1 if any(abs(i - p) <= t.REACH for p in targets) else 0
            sums[how + (4 if s == "x" else 0)] += weight or 1.0
        denied = t.REACH if s == "n" else max(0, denied - 1)
        reported = reported or s == "r"


def test_composed_tables_read_as_plain_steps_do():
    import random

    import numpy as np

    from weaklabel.llm import toxicity as t

    draw, grammar = random.Random(4), t.Grammar()
    for _ in range(2000):
        clause = [(s, draw.choice([0.5, 2.0]) if s == "i" else 0.0) for s in draw.choices(["", "t", "n", "r", "i", "x"], [6, 1, 1, 1, 2, 2], k=draw.randint(1, 14))]
        ours, want = np.zeros(8), np.zeros(8)
        grammar._read(clause, ours)
        plain_read(clause, want)
        assert ours.tolist() == want.tolist(), clause


def test_product_of_transducers():
    from weaklabel.llm import toxicity as t

    counting, lasting = t._counting("n", 2, 1), t._lasting("r", 2)
    both = t.compose(counting, lasting)
    assert both.follow.shape == (6, len(t.SYMBOLS))
    a = b = state = 0
    for s in ["", "n", "", "r", "", "n", "r", "", "", ""]:
        k = t.SYMBOLS.index(s)
        assert both.mark[state, k] == counting.mark[a, k] | lasting.mark[b, k]
        a, b, state = counting.follow[a, k], lasting.follow[b, k], both.follow[state, k]
        assert state == a * 2 + b


def test_scores_equal_brute_force(spark, tiny):
    """The scores of the whole table from the learned words and weights, clause by clause in plain Python."""
    import re

    import numpy as np

    from weaklabel.llm import toxicity as t

    docs, labels = (spark.read.parquet(f"{tiny}/{n}.parquet") for n in ("documents", "labels"))
    grammar = t.learn(docs, labels.where(~t.held_out("doc_id")))
    got = {r.doc_id: r.score for r in t.score(docs, grammar, ["doc_id"]).collect()}
    for row in docs.collect():
        sums = np.zeros(8)
        for clause in re.split(r"[.!?;:,\n]", row.text.lower()):
            plain_read([grammar.symbol(w) for w in re.findall(r"[^\W\d_]+", clause)], sums)
        assert abs(got[row.doc_id] - grammar.probability(sums)) < 1e-9
