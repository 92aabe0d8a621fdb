"""Mixing against a seat-by-seat apportionment."""

import hashlib
import heapq
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from weaklabel.llm.mixing import mix, seats, targets, whole_copies

SCHEMA = "doc_id long, text string, source string"


def shared(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        level = (total - sum(full.values())) / sum(weight[s] for s in open_)
        above = [s for s in open_ if level * weight[s] > most * sizes[s]]
        if not above:
            return full | {s: level * weight[s] for s in open_}
        for s in above:
            full[s] = most * sizes[s]
            open_.remove(s)
    return full


def dealt(votes, n):
    """Seats one by one to the highest quotient, ties to the smaller key."""
    queue = [(-v, k, 0) for k, v in votes.items() if v > 0]
    heapq.heapify(queue)
    won = Counter()
    for _ in range(n if queue else 0):
        _, k, s = heapq.heappop(queue)
        won[k] += 1
        heapq.heappush(queue, (-votes[k] / (2 * (s + 1) + 1), k, s + 1))
    return {k: won[k] for k in votes}


def test_seats(spark):
    draw = random.Random(6)
    rows, want = [], {}
    for case in range(40):
        votes = {k: draw.choice([0, 1, 1, draw.randint(1, 10), draw.randint(1, 10_000)]) for k in range(draw.randint(1, 9))}
        n = draw.choice([0, 1, 2, 7, 100, 1000])
        rows += [(case, k, float(v), n) for k, v in votes.items()]
        want |= {(case, k): s for k, s in dealt(votes, n).items()}
    frame = spark.createDataFrame(rows, "c long, k long, v double, n long")
    got = {(r.c, r.k): r.seats for r in seats(frame, "v", F.col("n"), ["c"], [F.col("k")]).collect()}
    assert got == want


def test_targets(spark):
    draw = random.Random(8)
    for _ in range(8):
        sizes = {f"s{i}": draw.choice([0, 3, draw.randint(0, 50), draw.randint(0, 5000)]) for i in range(draw.randint(1, 12))} | {None: draw.randint(0, 9)}
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in targets(frame).collect()}
        want = shared(sizes)
        assert set(got) == set(want) and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix_of_many_shards(spark):
    draw = random.Random(9)
    rows = [(i, " ".join(["w"] * draw.randint(0, 60)), draw.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(900)]
    docs = spark.createDataFrame(rows, SCHEMA)
    shards, block = 2000, 8
    got = {r.doc_id: r for r in mix(docs, ["doc_id"], block=block, shard_words=shards).collect()}
    again = {r.doc_id: r.taken for r in mix(docs.repartition(7), ["doc_id"], block=block, shard_words=shards).collect()}
    assert again == {i: r.taken for i, r in got.items()}
    sizes, taken, by_shard = Counter(), Counter(), defaultdict(dict)
    for i, t, s in rows:
        n = len(t.split())
        sizes[s] += n
        taken[s] += got[i].taken
        assert got[i].size == n and 0 <= got[i].taken <= 3 * n
    want = shared(sizes)
    seat = dealt({(s is None, s or ""): v for s, v in want.items()}, round(sum(sizes.values()) / block))
    for s in sizes:
        n_shards = max(1, -(-sizes[s] // shards))
        words = Counter({k: 0 for k in range(n_shards)})
        for i, t, source in rows:
            if source == s:
                words[int(hashlib.md5(f"{i}:".encode()).hexdigest()[:8], 16) % n_shards] += len(t.split())
        quota = dealt({k: float(v) for k, v in words.items()}, seat[(s is None, s or "")])
        assert taken[s] == sum(min(q * block, 3 * words[k]) for k, q in quota.items())
        assert abs(taken[s] - want[s]) <= block * (n_shards + 1)


def test_whole_copies_and_defined_cases(spark):
    rows = [(1, None, "a", 1), (None, "x y z", "b", 1), (2, "", None, 1), (3, "p q", "b", 1), (3, "p q", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    got = mix(docs, ["doc_id", "text", "source"], block=1).collect()
    assert sum(r.taken for r in got) <= 21 and {r.target for r in got if r.source != "b"} == {0.0}
    copies = whole_copies(mix(docs, ["doc_id", "text"], block=1), ["doc_id", "text"])
    assert set(copies.columns) == {"doc_id", "text"} and copies.where("text = ''").count() == 0
    assert mix(spark.createDataFrame([], SCHEMA), ["doc_id"]).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, " ", None)], SCHEMA)
    assert {(r.target, r.taken) for r in mix(nothing, ["doc_id"]).collect()} == {(0.0, 0)}
