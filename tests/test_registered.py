"""Every registered query against its SQL on the smallest tables, and the shape of the plans."""

import re
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_points
from weaklabel.catalog import CATALOG

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def comparable(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(
        tuple("NULL" if pd.isna(v) else repr(v.item() if hasattr(v, "item") else v) for v in row)
        for row in frame.itertuples(index=False, name=None)
    )


@pytest.fixture(scope="module")
def db(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n, e in CATALOG.items() if e.sql])
def test_query_equals_sql(spark, tiny, db, name):
    got = CATALOG[name].run(spark, tiny).toPandas()
    want = db.execute(CATALOG[name].sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert comparable(got) == comparable(want)


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["tp"] >= 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_sql_reads_whole_tables():
    for name, sql in entry_points.oracle_sql().items():
        assert not re.search(r"\b(USING SAMPLE|TABLESAMPLE)\b", sql), name


def test_code_has_no_forbidden_calls():
    root = Path(__file__).resolve().parents[1] / "weaklabel"
    # the optional part has the like test of its own
    for path in (p for p in root.rglob("*.py") if "llm" not in p.parts):
        text = path.read_text()
        for word in ("localCheckpoint", "crossJoin(", "broadcast(", "collect_set(", ".rdd", "toPandas("):
            assert word not in text, (path.name, word)


@pytest.mark.parametrize(
    "name", ["apply_rules", "respiratory_votes_final", "rule_summary_table", "threshold_sweep_table", "label_model_score", "rank_auc"]
)
def test_hot_paths_stay_out_of_python(spark, tiny, name):
    plan = CATALOG[name].run(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Python|MapInPandas|CartesianProduct|BroadcastNestedLoopJoin", plan)
