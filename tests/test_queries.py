import duckdb
import pandas as pd
import pytest

import __spark_entry__
from veritome.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


def plain(df):
    names = sorted(df.columns)
    cell = lambda x: None if x is None or (not hasattr(x, "__len__") and pd.isna(x)) else round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return names, sorted(([cell(x) for x in row] for row in df[names].itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    assert plain(QUERIES[name](spark, DATA).toPandas()) == plain(duck.execute(ORACLE[name]).df())


def scans(df):
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return plan, plan.count("FileScan parquet")


def test_filters_reach_the_scan(spark):
    from veritome import queries as q

    plan, n = scans(q._compiled(spark, DATA, q.Node("hits", q.Literal(q.NEEDLE), 5)).nodes[0])
    assert f"StringContains(text,{q.NEEDLE})" in plan and n == 3 and plan.count("FileScan parquet") == plan.count("ReadSchema") and "source" not in plan
    plan, n = scans(QUERIES["composed_lexical_hop_union"](spark, DATA))
    assert n <= 5  # nodes are computed once; the rest is the look-up of their rows


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE) <= set(__spark_entry__.oracle_sql())


def test_corpus_tools_are_optional(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    shutil.copytree(os.path.join(root, "veritome"), tmp_path / "veritome", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(__spark_entry__.__file__, tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert said.stdout.strip() == str(len(QUERIES)), said.stderr
