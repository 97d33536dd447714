"""Every query with SQL gives what DuckDB gives over the same tables."""

import importlib.util
import os

import duckdb
import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
spec = importlib.util.spec_from_file_location("__spark_entry__", os.path.join(os.path.dirname(__file__), "..", "__spark_entry__.py"))
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list:
    def text(x):
        if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and x != x:
            return ""
        return str(round(float(x), 6)) if isinstance(x, float) else str(int(x)) if not isinstance(x, str) else x

    return sorted(tuple(text(x) for x in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, db, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), db.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", ["compact_pages", "exhibits"])
def test_odd_references(spark, tmp_path, name):
    """References without a semicolon, cut off, doubled or of other names."""
    bodies = ["cut&amp", "a &ampx; b", "&&amp;&amp;quot; &lt;p&gt;", "&copy &copy; &am", "R&D &#65; &quot", None, "<b title='&amp'>x</b>&middot;&AMP;"]
    spark.createDataFrame(list(enumerate(bodies * 3)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert plain(entry.queries()[name](spark, str(tmp_path)).toPandas()) == plain(con.execute(entry.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
