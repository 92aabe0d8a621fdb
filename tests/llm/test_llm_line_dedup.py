"""Line dedup against brute force over all runs."""

import random

from weaklabel.llm.line_dedup import MIN_CHARS, remove_repeated_lines, repeated_runs

SCHEMA = "doc_id long, text string"


def brute(rows, least):
    """Line numbers (from 1) that lie in a run of ``least`` characters that also starts earlier."""
    lines = {i: t.split("\n") for i, t in rows}
    order = sorted(lines, key=lambda i: (i is not None, i))
    gone = {i: set() for i in lines}
    seen = {}
    for i in order:
        for p in range(len(lines[i])):
            for j, q in seen.setdefault(lines[i][p], []):
                n = 0
                while p + n < len(lines[i]) and q + n < len(lines[j]) and lines[i][p + n] == lines[j][q + n]:
                    n += 1
                if sum(len(s) + 1 for s in lines[i][p : p + n]) >= least:
                    gone[i] |= set(range(p + 1, p + n + 1))
            seen[lines[i][p]].append((i, p))
    return gone


def ours(spark, rows, least):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    texts = {r.doc_id: (r.text, r["__n_removed"]) for r in remove_repeated_lines(frame, min_chars=least).collect()}
    return texts


def check(spark, rows, least):
    gone = brute(rows, least)
    got = ours(spark, rows, least)
    for i, t in rows:
        kept = [s for k, s in enumerate(t.split("\n"), 1) if k not in gone[i]]
        assert got[i] == ("\n".join(kept), len(gone[i])), i


def test_random_lines(spark):
    draw = random.Random(4)
    for least in (3, 7, 12):
        pool = ["", "a", "bb", "ccc", "dddd", "eeeeeeeee", "a much longer line"]
        rows = [(i, "\n".join(draw.choice(pool) for _ in range(draw.randint(1, 12)))) for i in range(25)]
        check(spark, rows, least)


def test_whole_table(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    check(spark, rows, MIN_CHARS)
    runs = repeated_runs(docs).collect()
    assert runs and all(r.n_lines >= 1 for r in runs)
    assert sum(r.n_lines for r in runs) == sum(r["__n_removed"] for r in remove_repeated_lines(docs).collect())


def test_defined_cases(spark):
    line = "a line that is long enough to be a run"
    rows = [(1, None, 1), (2, "", 1), (3, line, 1), (3, line, 1), (None, line, 1), (5, f"own\n{line}\n", 1), (6, f"{line}\n" * 3, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_lines long").repartition(3)
    got = sorted(((r.doc_id or -1, r.text, r.n_lines, r["__n_removed"]) for r in remove_repeated_lines(frame).collect()), key=str)
    assert got == sorted([(1, None, 1, 0), (2, "", 1, 0), (3, "", 1, 1), (3, "", 1, 1), (-1, line, 1, 0), (5, "own\n", 1, 1), (6, "", 1, 4)], key=str)
    assert remove_repeated_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_rows_are_one_document(spark):
    line = "another line that is long enough to be a run"
    frame = spark.createDataFrame([(7, line)] * 3 + [(8, f"x\n{line}")], SCHEMA)
    got = sorted((r.doc_id, r.text) for r in remove_repeated_lines(frame).collect())
    assert got == [(7, line)] * 3 + [(8, "x")]


def test_no_python_in_the_plan(spark, tiny):
    plan = remove_repeated_lines(spark.read.parquet(f"{tiny}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_ranks_are_the_order_of_suffixes(spark):
    from pyspark.sql import functions as F

    from weaklabel.llm.line_dedup import _keyed, doubled, repeated_lines

    draw = random.Random(8)
    rows = [(i, "\n".join(draw.choice("abcd") for _ in range(draw.randint(1, 9)))) for i in range(12)]
    lines = repeated_lines(_keyed(spark.createDataFrame(rows, SCHEMA), "doc_id", "text"))
    texts = {i: t.split("\n") for i, t in rows}
    ranks = lines.select("id", "mark", "place", "rank")
    by_one = {texts[r.id][r.place - 1]: r["rank"] for r in lines.collect()}  # lines are sorted by a digest
    for level in range(3):
        ranks = doubled(ranks, level)
        size = 2 << level
        found = {(r.id, r.place): r["rank"] for r in ranks.collect()}
        runs = {(i, p + 1): tuple(t[p : p + size]) for i, t in texts.items() for p in range(len(t) - size + 1)}
        often = [run for run in runs.values() if sum(r == run for r in runs.values()) > 1]
        assert set(found) == {k for k, run in runs.items() if run in often}
        order = sorted(found, key=lambda k: [by_one[x] for x in runs[k]])
        assert [found[k] for k in order] == sorted(found.values())
        assert all((found[a] == found[b]) == (runs[a] == runs[b]) for a in found for b in found)


def test_a_very_long_document_of_short_lines(spark):
    draw = random.Random(10)
    lines = [draw.choice(["a", "bb", "ccc", "{", "}"]) for _ in range(20_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(lines[5_000:9_000])), (3, "one line of its own that is long enough")]
    got = ours(spark, rows, MIN_CHARS)
    assert got[2] == ("", 4000) and got[3][1] == 0 and got[1][1] < 2000
