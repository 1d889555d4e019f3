"""The entry points, and every query with SQL against DuckDB on the smallest tables."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(object).where(df.notna(), None).values.tolist()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.catalogue.QUERIES))
def test_query(spark, name):
    import duckdb

    got = entry.catalogue.QUERIES[name](spark, SF).toPandas()
    if name in entry.catalogue.ORACLE_SQL:
        con = duckdb.connect()
        for f in os.listdir(SF):
            con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
        want = con.execute(entry.catalogue.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    else:
        assert len(got)


def test_queries_without_the_llm_package(tmp_path):
    """The rest imports and lists its queries where the llm folders and the pipeline are gone."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    copy = tmp_path / "repo"
    subprocess.run(["cp", "-r", root, str(copy)], check=True)
    subprocess.run(["rm", "-rf", copy / "ridgeline/llm", copy / "tests/llm", copy / "corpus_pipeline.py"], check=True)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})
    assert out.stdout.split() == [str(len(entry.catalogue.QUERIES)), str(len(entry.catalogue.ORACLE_SQL))], out.stderr
