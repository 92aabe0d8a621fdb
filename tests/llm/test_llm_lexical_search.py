import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weaklabel.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [t.translate({i: i + 32 for i in range(65, 91)}) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    """Every score in plain Python, from the definition."""
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, words = sum(n > 0 for _, _, n in held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = defaultdict(Counter)
    for item, text in set(items):
        asked[item].update(terms(text))
    out = []
    for item, query in asked.items():
        scores = []
        for i, counts, n in held:
            score = 0
            for t, times in query.items():
                if t in counts:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 25 + 75 * n * n_docs // words
                    score += times * w * (1_000_000_000 * counts[t] // (1000 * counts[t] + 8 * m))
            if score > 0:
                scores.append((-score, i is not None, i if i is not None else 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(scores)[:k], 1):
            out.append((item, rank, i, -score))
    return sorted(out, key=repr)


def frames(spark, docs, items):
    left = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item_id": F.lit("x"), "score": F.lit(1), "rank": F.lit(2)})
    return left, spark.createDataFrame(items, "item_id int, text string").withColumn("doc_id", F.lit(3))


def found(spark, docs, items, k=10, parts=3, **options):
    left, right = frames(spark, docs, items)
    return sorted((tuple(r) for r in lexical_search.search(left.repartition(parts, "doc_id"), right, k=k, **options).collect()), key=repr)


def corpus(rng, n):
    words = [f"w{i}" for i in range(60)] + ["Ünïcode", "ÉCOLE", "日本", "x9"]
    weight = [1 / (i + 1) for i in range(len(words))]
    return [(i, " ".join(rng.choices(words, weight, k=rng.choice([1, 3, 20, 200])))) for i in range(n)]


@pytest.mark.parametrize("parts,first", [(1, 8), (12, 2)])
def test_equals_brute_force_over_any_slices(spark, parts, first):
    rng = random.Random(5)
    docs = corpus(rng, 150)
    docs += [(1000 + i, t) for i, t in docs[:40]]  # ties
    items = [(i, " ".join(rng.choices([w for _, t in docs for w in t.split()], k=6))) for i in range(20)]
    assert found(spark, docs, items, 5, parts, first_slices=first) == brute(docs, items, 5)


def test_nulls_repeats_and_clashing_columns(spark):
    docs = [(1, None), (2, ""), (3, "!!"), (None, "red Fox"), (5, "RED fox fox"), (5, "RED fox fox"), (7, "z" * 100_000 + " fox"), (8, "blue")]
    items = [(1, "fox, red fox"), (1, "fox, red fox"), (2, None), (3, "nothing here"), (None, "BLUE"), (4, "fox"), (4, "blue")]
    assert found(spark, docs, items) == brute(docs, items, 10)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == [] and found(spark, [(1, None)], [(1, "a")]) == []


def test_many_item_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "ITEMS", 3)
    docs = corpus(random.Random(1), 30)
    items = [(i, t) for i, t in docs[:10]]
    assert found(spark, docs, items, 3) == brute(docs, items, 3)


def test_reads_stop_before_the_lists_end():
    rng = np.random.default_rng(0)
    lists, good = [], 1e6 * rng.pareto(1.0, 5000)
    for _ in range(3):  # documents that are good for one term are mostly so for the others
        scores = (good * rng.uniform(0.7, 1.3, 5000)).astype(np.int64)
        docs = np.argsort(-scores, kind="stable")
        lists.append((docs.astype(np.int32), scores[docs]))
    ids = np.arange(5000) * 7
    whole = np.zeros(5000, dtype=np.int64)
    for docs, scores in lists:
        whole[docs] += scores
    want = np.lexsort((ids, -whole))[:10]
    got, scores, read = lexical_search.nra(lists, ids, 10)
    assert got.tolist() == want.tolist() and scores.tolist() == whole[want].tolist()
    assert read < 15_000, "the reads went to the end of all lists"
    # a bar that nothing reaches ends the reads at once; one that the tenth meets keeps all ten
    none, _, few = lexical_search.nra(lists, ids, 10, bar=int(whole.max()) + 1)
    assert len(none) == 0 and few <= read
    same, _, _ = lexical_search.nra(lists, ids, 10, bar=int(whole[want[-1]]))
    assert same.tolist() == want.tolist()


def test_long_documents_in_a_large_corpus_stay_exact():
    n, docs = np.array([10**9]), 10**11
    assert lexical_search.impacts(np.array([3]), n, docs, 10**13).tolist() == [3 * 10**9 // (3000 + 8 * (25 + 75 * 10**9 * docs // 10**13))]
