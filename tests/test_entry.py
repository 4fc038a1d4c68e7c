import os
import re
import sys

import pytest

import __spark_entry__ as entry
from skeinworks import plans

SMALL = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_and_sql_fit():
    assert set(plans.oracle_sql()) <= set(plans.queries()) and {f"p{n}_found" for n in (1, 2, 3, 4, 6)} <= set(plans.queries())


def test_nothing_else_imports_the_text_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "skeinworks")):
        if os.path.basename(folder) != "llm":
            for name in files:
                if name.endswith(".py"):
                    assert not re.search(r"^\s*(?:from|import)\s+skeinworks\.llm", open(os.path.join(folder, name)).read(), re.M), name


def test_entry_without_the_text_subpackage(monkeypatch):
    # As where the folder is gone, or only its compiled files are left.
    monkeypatch.setitem(sys.modules, "skeinworks.llm.queries", None)
    assert set(entry.queries()) == set(plans.queries()) and set(entry.oracle_sql()) == set(plans.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
def test_queries_match_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SMALL}/{name}')")
    plain = lambda v: v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v
    for name, sql in plans.oracle_sql().items():
        df = plans.queries()[name](spark, SMALL)
        columns = sorted(df.columns)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
        answer = con.execute(sql)
        order = [[d[0] for d in answer.description].index(c) for c in columns]
        want = sorted((tuple(plain(r[i]) for i in order) for r in answer.fetchall()), key=str)
        assert got == want, name


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
def test_filters_and_columns_reach_the_scan(spark):
    plan = lambda name: plans.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan("item_latest") and "ReadSchema" in plan("item_latest")
    scans = [line for line in plan("land_acreage").splitlines() if "FileScan" in line]
    assert all("seller" not in line for line in scans) and scans
    limited = plan("search_since_topk")
    assert "TakeOrderedAndProject" in limited
    assert "WindowGroupLimit" in plan("item_latest")
