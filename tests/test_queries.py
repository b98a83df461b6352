"""Every registered query with SQL gives the rows that DuckDB gives."""

import os

import pytest

from whyframe.queries import ORACLES, QUERIES

SF = os.environ.get("WHYFRAME_TESTDATA", "/root/testdata/sf0.001")
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in NAMES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rounded(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted(str([rounded(r[c]) for c in columns]) for r in df.collect())
    assert got == sorted(str([rounded(r[c]) for c in columns]) for r in (dict(zip(want.columns, x)) for x in want.fetchall()))


def test_index_holds_every_row(spark):
    got = {r.table_name: r["count"] for r in QUERIES["index_docs_all"](spark, SF).groupBy("table_name").count().collect()}
    assert got == {t: spark.read.parquet(f"{SF}/{t}.parquet").count() for t in "region nation customer supplier part orders lineitem".split()}


def test_entry(spark):
    import __spark_entry__

    assert set(ORACLES) <= set(__spark_entry__.oracle_sql()) and set(QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
