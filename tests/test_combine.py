"""Running descriptors: the same rows and provenance as the queries they describe."""

import pytest

from whyframe.operators.combine import DescriptorError, query_of, run_descriptor
from whyframe.operators.provenance import sql_with_why
from whyframe.plans.descriptor import describe
from whyframe.queries import SQL, TABLES, _register

NO_SELECT = {"pipe_syntax", "union_all", "union_distinct", "intersect", "except"}
QUERIES = {k: v[0] for k, v in SQL.items() if k != "flagship"}
MORE = {
    "natural": "SELECT n_name, r_name FROM nation NATURAL JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) x WHERE n_name LIKE '%1'",
    "using_tables": "SELECT n_nationkey, a.n_name, b.n_name AS other FROM nation a LEFT JOIN nation b USING (n_nationkey) WHERE a.n_regionkey IN (1, 2) ORDER BY n_nationkey DESC LIMIT 4",
    "cte_twice": "WITH k AS (SELECT n_regionkey AS r, count(*) AS c FROM nation GROUP BY n_regionkey) SELECT a.r, b.c FROM k a JOIN k b ON a.r = b.r JOIN region ON r_regionkey = a.r",
    "bare_exists": "SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND n_name LIKE '%2')",
    "star": "SELECT * FROM nation n JOIN region ON n.n_regionkey = r_regionkey WHERE r_name BETWEEN 'A' AND 'B'",
    "no_table": "SELECT 1 AS x, 'a' AS y",
    "left_lateral": "SELECT n.n_name, x.c FROM nation n LEFT JOIN LATERAL (SELECT s_suppkey AS c FROM supplier WHERE s_nationkey = n.n_nationkey) x ON x.c > 3",
}


@pytest.fixture(scope="module", autouse=True)
def tables(spark):
    _register(spark, "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", [*(k for k in QUERIES if k not in NO_SELECT), *MORE])
def test_as_the_query(spark, name):
    sql = (QUERIES | MORE)[name]
    want, got = sql_with_why(spark, sql, tables=set(TABLES)), run_descriptor(spark, describe(spark, sql), tables=set(TABLES))
    assert got.columns == want.columns
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str(tuple(r)) for r in want.collect())


def test_modes_and_views(spark):
    plan = describe(spark, SQL["group_agg"][0])
    assert "why" not in run_descriptor(spark, plan, "off", set(TABLES)).columns
    assert sum(r.why for r in run_descriptor(spark, plan, "count", set(TABLES)).collect()) == sum(r.num_customers for r in run_descriptor(spark, plan, "off").collect())
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("__leaf")]


@pytest.mark.parametrize("sql", ["SELECT p FROM nation LATERAL VIEW explode(array(1, 2)) t AS p", "SELECT k FROM (SELECT n_nationkey FROM nation) x(k)", "WITH w(k) AS (SELECT n_nationkey FROM nation) SELECT k FROM w", "SELECT id FROM range(3)", "SELECT n_name FROM nation JOIN (region JOIN supplier ON r_regionkey = s_nationkey) ON n_nationkey = s_nationkey"])
def test_what_a_descriptor_cannot_tell_is_refused(spark, sql):
    with pytest.raises(DescriptorError):
        run_descriptor(spark, describe(spark, sql), tables=set(TABLES))


def test_only_full_descriptors(spark):
    plan = describe(spark, SQL["group_agg"][0], compat=True)
    with pytest.raises(DescriptorError):
        query_of(plan, {0: "a", 1: "b"})
