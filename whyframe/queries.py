"""Registered queries of the engine, each with the same result said in DuckDB SQL.

Provenance is compared as its formula text. The SQL spells the provenance rules
out by hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import html_escape
from .operators import answers, cells, leaves, retrieval
from .operators.provenance import WHY, sql_with_why
from .plans.descriptor import describe
from .sources import catalog, tables
from .sources.tables import RID

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]

# DuckDB texts of the row-id rules.
_RID = {
    "region": "'region_' || (r_regionkey + 1)",
    "nation": "'nation_' || (n_nationkey + 1)",
    "customer": "'customer_' || (c_custkey + 1)",
    "supplier": "'supplier_' || (s_suppkey + 1)",
    "part": "'part_' || (p_partkey + 1)",
    "orders": "'orders_' || (o_orderkey + 1)",
    "lineitem": "concat_ws('_', 'lineitem', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity * 100)::BIGINT, round(l_extendedprice * 100)::BIGINT)",
}


def _t(name: str) -> str:
    return f"(SELECT *, {_RID[name]} AS rid FROM {name})"


def _w(*rids: str) -> str:
    return f"list_sort(list_distinct(list_filter([{', '.join(rids)}], lambda x: x IS NOT NULL)))"


def _formula(sets: str) -> str:
    return f"array_to_string(list_transform(list_sort(list_distinct({sets})), lambda w: CASE WHEN len(w) = 1 THEN w[1] ELSE '(' || array_to_string(w, ' AND ') || ')' END), ' OR ')"


def _one(*rids: str) -> str:
    return f"{_formula(f'[{_w(*rids)}]')} AS why"


def _sum(*rids: str) -> str:
    return f"{_formula(f'list({_w(*rids)})')} AS why"


N, R, C, S, O, L = (_t(x) for x in ("nation", "region", "customer", "supplier", "orders", "lineitem"))

#: Customers as a tree, each under the one whose key is a tenth of its own; walks go down from keys 1 to 9.
_TREE = "WITH RECURSIVE t(k, depth) AS (SELECT c_custkey, 0 FROM customer WHERE c_custkey BETWEEN 1 AND 9 UNION ALL SELECT c.c_custkey, t.depth + 1 FROM t JOIN customer c ON c.c_custkey DIV 10 = t.k{})"
_TREE_SQL = f"WITH RECURSIVE t(k, depth, w) AS (SELECT c_custkey, 0, [rid] FROM {C} WHERE c_custkey BETWEEN 1 AND 9 UNION ALL SELECT c.c_custkey, t.depth + 1, {{}} FROM t JOIN {C} c ON c.c_custkey // 10 = t.k{{}})"
_PATHS = _TREE_SQL.format("list_append(t.w, c.rid)", "")
_PATH = _formula("[list_sort(list_distinct(t.w))]") + " AS why"
_PATH_AND_NATION = _formula("list(list_sort(list_distinct(t.w || [u.rid, n.rid])))") + " AS why"
_NATIONS = " JOIN (SELECT n_nationkey, list(rid) AS ids FROM " + N + " WHERE n_regionkey IN (1, 3) GROUP BY n_nationkey) n ON c.c_nationkey = n.n_nationkey"

#: name -> (query for the engine, the same with provenance in DuckDB SQL)
SQL: dict[str, tuple[str, str]] = {
    "filter_leaf_scan": (
        "SELECT n.n_nationkey, n.n_name FROM nation n WHERE n.n_regionkey = 1",
        f"SELECT n.n_nationkey, n.n_name, {_one('n.rid')} FROM {N} n WHERE n.n_regionkey = 1",
    ),
    "leaf_scan": ("SELECT n.n_name FROM nation n", f"SELECT n.n_name, {_one('n.rid')} FROM {N} n"),
    "select_star": ("SELECT * FROM supplier", f"SELECT s.* EXCLUDE (rid), {_one('s.rid')} FROM {S} s"),
    "filter_conjuncts": (
        "SELECT c.c_custkey FROM customer c WHERE c.c_acctbal > 1000 AND c.c_nationkey < 5 AND c.c_mktsegment = 'FURNITURE'",
        f"SELECT c.c_custkey, {_one('c.rid')} FROM {C} c WHERE c.c_acctbal > 1000 AND c.c_nationkey < 5 AND c.c_mktsegment = 'FURNITURE'",
    ),
    "filter_single_table_or": (
        "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE n.n_nationkey = 3 OR n.n_name = 'NATION_1'",
        f"SELECT n.n_name, r.r_name, {_one('n.rid', 'r.rid')} FROM {N} n JOIN {R} r ON n.n_regionkey = r.r_regionkey WHERE n.n_nationkey = 3 OR n.n_name = 'NATION_1'",
    ),
    "filter_cross_table_or": (
        "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE (n.n_nationkey < 10 AND r.r_name = 'ASIA') OR (n.n_nationkey > 15 AND r.r_name = 'EUROPE')",
        f"SELECT n.n_name, r.r_name, {_one('n.rid', 'r.rid')} FROM {N} n JOIN {R} r ON n.n_regionkey = r.r_regionkey WHERE (n.n_nationkey < 10 AND r.r_name = 'ASIA') OR (n.n_nationkey > 15 AND r.r_name = 'EUROPE')",
    ),
    "project_expr": (
        "SELECT c.c_custkey, upper(c.c_mktsegment) AS seg, round(c.c_acctbal * 2, 2) AS dbl FROM customer c",
        f"SELECT c.c_custkey, upper(c.c_mktsegment) AS seg, round(c.c_acctbal * 2, 2) AS dbl, {_one('c.rid')} FROM {C} c",
    ),
    "scalar_mix": (
        "SELECT o.o_orderkey, year(o.o_orderdate) AS y, month(o.o_orderdate) AS m, length(o.o_orderpriority) AS n, coalesce(nullif(o.o_orderstatus, 'F'), '-') AS st, CASE WHEN o.o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size, abs(o.o_totalprice - 1000) > 500 AS far FROM orders o",
        f"SELECT o.o_orderkey, year(o.o_orderdate)::INT AS y, month(o.o_orderdate)::INT AS m, length(o.o_orderpriority)::INT AS n, coalesce(nullif(o.o_orderstatus, 'F'), '-') AS st, CASE WHEN o.o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size, abs(o.o_totalprice - 1000) > 500 AS far, {_one('o.rid')} FROM {O} o",
    ),
    "join_inner": (
        "SELECT c.c_custkey, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey",
        f"SELECT c.c_custkey, n.n_name, {_one('c.rid', 'n.rid')} FROM {C} c JOIN {N} n ON c.c_nationkey = n.n_nationkey",
    ),
    "join_4way": (
        "SELECT o.o_orderkey, c.c_name, n.n_name, r.r_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE o.o_totalprice > 300000",
        f"SELECT o.o_orderkey, c.c_name, n.n_name, r.r_name, {_one('o.rid', 'c.rid', 'n.rid', 'r.rid')} FROM {O} o JOIN {C} c ON o.o_custkey = c.c_custkey JOIN {N} n ON c.c_nationkey = n.n_nationkey JOIN {R} r ON n.n_regionkey = r.r_regionkey WHERE o.o_totalprice > 300000",
    ),
    "join_comma": (
        "SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey",
        f"SELECT n.n_name, r.r_name, {_one('n.rid', 'r.rid')} FROM {N} n, {R} r WHERE n.n_regionkey = r.r_regionkey",
    ),
    "join_left": (
        "SELECT n.n_name, c.c_custkey FROM nation n LEFT JOIN customer c ON n.n_nationkey = c.c_nationkey AND c.c_acctbal > 9900",
        f"SELECT n.n_name, c.c_custkey, {_one('n.rid', 'c.rid')} FROM {N} n LEFT JOIN {C} c ON n.n_nationkey = c.c_nationkey AND c.c_acctbal > 9900",
    ),
    "join_right": (
        "SELECT n.n_name, c.c_custkey FROM customer c RIGHT JOIN nation n ON n.n_nationkey = c.c_nationkey AND c.c_acctbal > 9900",
        f"SELECT n.n_name, c.c_custkey, {_one('n.rid', 'c.rid')} FROM {C} c RIGHT JOIN {N} n ON n.n_nationkey = c.c_nationkey AND c.c_acctbal > 9900",
    ),
    "join_full": (
        "SELECT n.n_name, s.s_suppkey FROM nation n FULL OUTER JOIN supplier s ON n.n_nationkey = s.s_nationkey AND s.s_acctbal > 5000",
        f"SELECT n.n_name, s.s_suppkey, {_one('n.rid', 's.rid')} FROM {N} n FULL OUTER JOIN {S} s ON n.n_nationkey = s.s_nationkey AND s.s_acctbal > 5000",
    ),
    "join_cross": (
        "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n",
        f"SELECT r.r_name, n.n_name, {_one('r.rid', 'n.rid')} FROM {R} r CROSS JOIN {N} n",
    ),
    "join_theta": (
        "SELECT a.s_suppkey AS k, b.r_regionkey AS r FROM supplier a JOIN region b ON a.s_nationkey < b.r_regionkey",
        f"SELECT a.s_suppkey AS k, b.r_regionkey AS r, {_one('a.rid', 'b.rid')} FROM {S} a JOIN {R} b ON a.s_nationkey < b.r_regionkey",
    ),
    "join_self": (
        "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <= b.n_nationkey",
        f"SELECT a.n_name AS a, b.n_name AS b, {_one('a.rid', 'b.rid')} FROM {N} a JOIN {N} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <= b.n_nationkey",
    ),
    "join_using": (
        "SELECT x.n_name, count(*) AS c FROM nation x JOIN (SELECT c_nationkey AS n_nationkey FROM customer) y USING (n_nationkey) GROUP BY x.n_name",
        f"SELECT x.n_name, count(*) AS c, {_sum('x.rid', 'y.rid')} FROM {N} x JOIN (SELECT c_nationkey AS n_nationkey, rid FROM {C}) y USING (n_nationkey) GROUP BY x.n_name",
    ),
    "join_semi": (
        "SELECT n.n_name FROM nation n WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9900)",
        f"SELECT any_value(n.n_name) AS n_name, {_sum('n.rid', 'c.rid')} FROM {N} n JOIN {C} c ON c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9900 GROUP BY n.rid",
    ),
    "join_in": (
        "SELECT s.s_suppkey FROM supplier s WHERE s.s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)",
        f"SELECT s.s_suppkey, {_one('s.rid', 'n.rid')} FROM {S} s JOIN {N} n ON s.s_nationkey = n.n_nationkey WHERE n.n_regionkey = 2",
    ),
    "join_anti": (
        "SELECT n.n_name FROM nation n WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9900)",
        f"SELECT n.n_name, {_one('n.rid')} FROM {N} n WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9900)",
    ),
    "group_agg": (
        "SELECT n.n_name, count(*) AS num_customers FROM nation n JOIN customer c ON n.n_nationkey = c.c_nationkey WHERE n.n_regionkey = 1 AND c.c_acctbal > 1000 GROUP BY n.n_name",
        f"SELECT n.n_name, count(*) AS num_customers, {_sum('n.rid', 'c.rid')} FROM {N} n JOIN {C} c ON n.n_nationkey = c.c_nationkey WHERE n.n_regionkey = 1 AND c.c_acctbal > 1000 GROUP BY n.n_name",
    ),
    "agg_all_five": (
        "SELECT c.c_mktsegment, count(*) AS n, round(sum(c.c_acctbal), 2) AS s, round(avg(c.c_acctbal), 4) AS a, min(c.c_acctbal) AS lo, max(c.c_acctbal) AS hi FROM customer c GROUP BY c.c_mktsegment",
        f"SELECT c.c_mktsegment, count(*) AS n, round(sum(c.c_acctbal), 2) AS s, round(avg(c.c_acctbal), 4) AS a, min(c.c_acctbal) AS lo, max(c.c_acctbal) AS hi, {_sum('c.rid')} FROM {C} c GROUP BY c.c_mktsegment",
    ),
    "group_by_expr": (
        "SELECT c.c_custkey % 7 AS b, count(*) AS n FROM customer c GROUP BY c.c_custkey % 7",
        f"SELECT c.c_custkey % 7 AS b, count(*) AS n, {_sum('c.rid')} FROM {C} c GROUP BY c.c_custkey % 7",
    ),
    "global_agg": (
        "SELECT count(*) AS n, max(s.s_acctbal) AS hi FROM supplier s WHERE s.s_nationkey = 3",
        f"SELECT count(*) AS n, max(s.s_acctbal) AS hi, {_sum('s.rid')} FROM {S} s WHERE s.s_nationkey = 3",
    ),
    "agg_empty": (
        "SELECT count(*) AS n FROM supplier s WHERE s.s_nationkey = -1",
        "SELECT count(*) AS n, '' AS why FROM supplier s WHERE s.s_nationkey = -1",
    ),
    "agg_distinct": (
        "SELECT c.c_nationkey, count(DISTINCT c.c_mktsegment) AS d FROM customer c GROUP BY c.c_nationkey",
        f"SELECT c.c_nationkey, count(DISTINCT c.c_mktsegment) AS d, {_sum('c.rid')} FROM {C} c GROUP BY c.c_nationkey",
    ),
    "having": (
        "SELECT c.c_nationkey, count(*) AS n FROM customer c GROUP BY c.c_nationkey HAVING count(*) > 60",
        f"SELECT c.c_nationkey, count(*) AS n, {_sum('c.rid')} FROM {C} c GROUP BY c.c_nationkey HAVING count(*) > 60",
    ),
    "select_distinct": (
        "SELECT DISTINCT c.c_nationkey, c.c_mktsegment FROM customer c",
        f"SELECT c.c_nationkey, c.c_mktsegment, {_sum('c.rid')} FROM {C} c GROUP BY ALL",
    ),
    "rollup": (
        "SELECT n.n_regionkey, n.n_name, count(*) AS n FROM nation n JOIN supplier s ON n.n_nationkey = s.s_nationkey GROUP BY ROLLUP (n.n_regionkey, n.n_name)",
        f"SELECT n.n_regionkey, n.n_name, count(*) AS n, {_sum('n.rid', 's.rid')} FROM {N} n JOIN {S} s ON n.n_nationkey = s.s_nationkey GROUP BY ROLLUP (n.n_regionkey, n.n_name)",
    ),
    "window_sum": (
        "SELECT s.s_suppkey, round(sum(s.s_acctbal) OVER (PARTITION BY s.s_nationkey), 2) AS t FROM supplier s",
        f"SELECT s.s_suppkey, round(sum(s.s_acctbal) OVER (PARTITION BY s.s_nationkey), 2) AS t, {_one('s.rid')} FROM {S} s",
    ),
    "scalar_subquery": (
        "SELECT s.s_suppkey FROM supplier s WHERE s.s_acctbal > (SELECT avg(s_acctbal) FROM supplier)",
        f"SELECT s.s_suppkey, {_one('s.rid')} FROM {S} s WHERE s.s_acctbal > (SELECT avg(s_acctbal) FROM supplier)",
    ),
    "recursive_paths": (
        f"{_TREE.format('')} SELECT k, depth FROM t",
        f"{_PATHS} SELECT k, depth, {_PATH} FROM t",
    ),
    "recursive_levels": (
        f"{_TREE.format('')} SELECT n.n_name, t.depth, count(*) AS c FROM t JOIN customer u ON u.c_custkey = t.k JOIN nation n ON u.c_nationkey = n.n_nationkey GROUP BY n.n_name, t.depth",
        f"{_PATHS} SELECT n.n_name, t.depth, count(*) AS c, {_PATH_AND_NATION} FROM t JOIN {C} u ON u.c_custkey = t.k JOIN {N} n ON u.c_nationkey = n.n_nationkey GROUP BY n.n_name, t.depth",
    ),
    "recursive_semi": (
        f"{_TREE.format(' WHERE c.c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3))')} SELECT k, depth FROM t",
        f"{_TREE_SQL.format('t.w || [c.rid] || n.ids', _NATIONS)} SELECT k, depth, {_PATH} FROM t",
    ),
    "scalar_correlated": (
        "SELECT r.r_name, (SELECT max(n.n_name) FROM nation n WHERE n.n_regionkey = r.r_regionkey) AS last_name, (SELECT count(*) FROM nation n WHERE n.n_regionkey = r.r_regionkey AND n.n_nationkey > 20) AS late FROM region r",
        f"SELECT r.r_name, (SELECT max(n.n_name) FROM nation n WHERE n.n_regionkey = r.r_regionkey) AS last_name, (SELECT count(*) FROM nation n WHERE n.n_regionkey = r.r_regionkey AND n.n_nationkey > 20) AS late, {_one('r.rid')} FROM {R} r",
    ),
    "scalar_correlated_where": (
        "SELECT n.n_name, c.c_custkey FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE c.c_acctbal > (SELECT avg(d.c_acctbal) FROM customer d WHERE d.c_nationkey = c.c_nationkey AND d.c_mktsegment = c.c_mktsegment)",
        f"SELECT n.n_name, c.c_custkey, {_one('c.rid', 'n.rid')} FROM {C} c JOIN {N} n ON c.c_nationkey = n.n_nationkey WHERE c.c_acctbal > (SELECT avg(d.c_acctbal) FROM customer d WHERE d.c_nationkey = c.c_nationkey AND d.c_mktsegment = c.c_mktsegment)",
    ),
    "scalar_correlated_having": (
        "SELECT c.c_nationkey, count(*) AS n FROM customer c GROUP BY c.c_nationkey HAVING count(*) > (SELECT 10 * count(*) FROM supplier s WHERE s.s_nationkey = c.c_nationkey)",
        f"SELECT c.c_nationkey, count(*) AS n, {_sum('c.rid')} FROM {C} c GROUP BY c.c_nationkey HAVING count(*) > (SELECT 10 * count(*) FROM supplier s WHERE s.s_nationkey = c.c_nationkey)",
    ),
    "join_semi_theta": (
        "SELECT n.n_name FROM nation n WHERE EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey < n.n_nationkey AND s.s_acctbal > 8000)",
        f"SELECT any_value(n.n_name) AS n_name, {_sum('n.rid', 's.rid')} FROM {N} n JOIN {S} s ON s.s_nationkey < n.n_nationkey AND s.s_acctbal > 8000 GROUP BY n.rid",
    ),
    "join_in_or": (
        "SELECT s.s_suppkey FROM supplier s WHERE s.s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) OR s.s_acctbal > 5000",
        f"SELECT s.s_suppkey, {_one('s.rid', 'n.rid')} FROM {S} s LEFT JOIN {N} n ON s.s_nationkey = n.n_nationkey AND n.n_regionkey = 2 WHERE n.rid IS NOT NULL OR s.s_acctbal > 5000",
    ),
    "join_not_in_or": (
        "SELECT n.n_name FROM nation n WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey) OR n.n_regionkey = 2",
        f"SELECT n.n_name, {_one('n.rid')} FROM {N} n WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey) OR n.n_regionkey = 2",
    ),
    "exists_selected": (
        "SELECT n.n_name, EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9900) AS rich FROM nation n",
        f"SELECT any_value(n.n_name) AS n_name, count(c.rid) > 0 AS rich, {_sum('n.rid', 'c.rid')} FROM {N} n LEFT JOIN {C} c ON c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9900 GROUP BY n.rid",
    ),
    "join_lateral": (
        "SELECT n.n_name, x.s_suppkey FROM nation n, LATERAL (SELECT s.s_suppkey FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > 1000) x",
        f"SELECT n.n_name, s.s_suppkey, {_one('n.rid', 's.rid')} FROM {N} n JOIN {S} s ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 1000",
    ),
    "pipe_syntax": (
        "FROM customer |> WHERE c_acctbal > 9000 |> AGGREGATE count(*) AS n GROUP BY c_nationkey |> WHERE n > 3",
        f"SELECT c_nationkey, count(*) AS n, {_sum('rid')} FROM {C} WHERE c_acctbal > 9000 GROUP BY c_nationkey HAVING count(*) > 3",
    ),
    "cte": (
        "WITH rich AS (SELECT c_nationkey, c_custkey FROM customer WHERE c_acctbal > 9000) SELECT n.n_name, count(*) AS n FROM nation n JOIN rich ON rich.c_nationkey = n.n_nationkey GROUP BY n.n_name",
        f"SELECT n.n_name, count(*) AS n, {_sum('n.rid', 'c.rid')} FROM {N} n JOIN {C} c ON c.c_nationkey = n.n_nationkey WHERE c.c_acctbal > 9000 GROUP BY n.n_name",
    ),
    "order_by_limit": (
        "SELECT c.c_custkey, c.c_acctbal FROM customer c ORDER BY c.c_acctbal DESC, c.c_custkey LIMIT 10",
        f"SELECT c.c_custkey, c.c_acctbal, {_one('c.rid')} FROM {C} c ORDER BY c.c_acctbal DESC, c.c_custkey LIMIT 10",
    ),
    "offset_limit": (
        "SELECT c.c_custkey FROM customer c ORDER BY c.c_custkey LIMIT 10 OFFSET 20",
        f"SELECT c.c_custkey, {_one('c.rid')} FROM {C} c ORDER BY c.c_custkey LIMIT 10 OFFSET 20",
    ),
    "union_all": (
        "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
        f"SELECT c_nationkey AS k, {_one('rid')} FROM {C} UNION ALL SELECT s_nationkey, {_one('rid')} FROM {S}",
    ),
    "union_distinct": (
        "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
        f"SELECT k, {_sum('rid')} FROM (SELECT c_nationkey AS k, rid FROM {C} UNION ALL SELECT s_nationkey, rid FROM {S}) GROUP BY k",
    ),
    "intersect": (
        "SELECT c_mktsegment AS k FROM customer WHERE c_nationkey = 1 INTERSECT SELECT c_mktsegment FROM customer WHERE c_nationkey = 2",
        f"SELECT a.c_mktsegment AS k, {_sum('a.rid', 'b.rid')} FROM {C} a JOIN {C} b ON a.c_mktsegment = b.c_mktsegment WHERE a.c_nationkey = 1 AND b.c_nationkey = 2 GROUP BY a.c_mktsegment",
    ),
    "except": (
        "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
        f"SELECT n_nationkey AS k, {_sum('rid')} FROM {N} WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) GROUP BY n_nationkey",
    ),
    "flagship": (
        "SELECT r.r_name, n.n_name, count(*) AS items, CAST(sum(CAST(l.l_extendedprice * (1 - l.l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE l.l_returnflag = 'R' GROUP BY r.r_name, n.n_name",
        f"SELECT r.r_name, n.n_name, count(*) AS items, CAST(sum(CAST(l.l_extendedprice * (1 - l.l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue, {_sum('l.rid', 'o.rid', 'c.rid', 'n.rid', 'r.rid')} FROM {L} l JOIN {O} o ON l.l_orderkey = o.o_orderkey JOIN {C} c ON o.o_custkey = c.c_custkey JOIN {N} n ON c.c_nationkey = n.n_nationkey JOIN {R} r ON n.n_regionkey = r.r_regionkey WHERE l.l_returnflag = 'R' GROUP BY r.r_name, n.n_name",
    ),
}


def _register(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    found = tables.read_parquet_tables(spark, sf_dir, TABLES)
    tables.register(spark, found)
    return found


def _sql_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _register(spark, sf_dir)
        return sql_with_why(spark, SQL[name][0], prov="formula", tables=set(TABLES))

    return run


def _with_tables(run: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]):
    return lambda spark, sf_dir: run(spark, _register(spark, sf_dir))


def _answers(spark: SparkSession) -> DataFrame:
    """Provenance of customers by nation and market segment, with faults planted by rule in some answers."""
    df = sql_with_why(spark, "SELECT c.c_nationkey, c.c_mktsegment, count(*) AS n FROM customer c GROUP BY c.c_nationkey, c.c_mktsegment", tables=set(TABLES))
    key = F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment")
    fault = F.pmod("c_nationkey", F.lit(5))
    first = F.get("why", 0)
    faulty = F.when(fault == 1, F.concat("why", F.array(F.array().cast("array<string>")))).when(fault == 2, F.concat("why", F.array(F.concat(first, first)))).when(fault == 3, F.concat("why", F.array(F.array(F.lit("nowhere_1"))))).when(fault == 4, F.concat("why", F.array(first))).otherwise(F.col("why"))
    return df.select(key.alias("id"), faulty.alias("provenance"), F.to_json(F.struct("n")).alias("result"))


_ANSWERS = f"""a AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, list_sort(list_distinct(list([rid]))) AS why FROM {C} GROUP BY ALL),
f AS (SELECT concat_ws('/', c_nationkey, c_mktsegment) AS id, n, CASE c_nationkey % 5 WHEN 1 THEN list_concat(why, [[]::VARCHAR[]]) WHEN 2 THEN list_concat(why, [list_concat(why[1], why[1])]) WHEN 3 THEN list_concat(why, [['nowhere_1']]) WHEN 4 THEN list_concat(why, [why[1]]) ELSE why END AS p FROM a),
s AS (SELECT id, unnest(p) AS w, generate_subscripts(p, 1) - 1 AS set_no FROM f)"""


def _candidates(spark: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
    """Ids to resolve: every nation's number in two tables, some of them unknown."""
    return t["nation"].select(F.explode(F.array(*[F.concat(F.lit(f"{n}_"), (F.col("n_nationkey") * 3).cast("string")) for n in ("nation", "region", "supplier")])).alias("rid"))


_CANDIDATES = "SELECT n || '_' || (n_nationkey * 3) AS rid FROM nation, (SELECT unnest(['nation', 'region', 'supplier']) AS n)"
_INDEX = " UNION ALL ".join(f"SELECT '{t}' AS table_name, {_RID[t]} AS rid FROM {t}" for t in TABLES)


def _resolve(spark, t):
    return tables.resolve(_candidates(spark, t), t).select("rid", "table_name", F.col("row").isNotNull().alias("found"))


_EXPLAINED = f"""SELECT r.r_name AS id, 'Question: How many nations has each region?' || chr(10) || 'Result: {{"r_name":"' || r.r_name || '","c":' || count(*) || '}}' || chr(10) || 'Provenance, ' || count(*) || ' derivation(s):' || chr(10)
|| string_agg('- ' || n.rid || ' (n_name ' || n.n_name || ', n_nationkey ' || n.n_nationkey || ', n_regionkey ' || n.n_regionkey || ') together with ' || r.rid || ' (r_name ' || r.r_name || ', r_regionkey ' || r.r_regionkey || ')', chr(10) ORDER BY n.rid) AS explanation
FROM {N} n JOIN {R} r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name"""


def _leaf_ids(spark: SparkSession, t: dict[str, DataFrame], sql: str) -> DataFrame:
    """(leaf_no, table_name, rid): what the leaves of a query's descriptor read."""
    tables.register(spark, t)
    out = None
    for i, (task, df) in enumerate(leaves.run_leaves(spark, describe(spark, sql))):
        part = df.select(F.lit(i).alias("leaf_no"), F.lit(task["table_name"].lower()).alias("table_name"), F.col(RID).alias("rid"))
        out = part if out is None else out.unionByName(part)
    return out


def _leaf_sql(*scans: tuple[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS leaf_no, '{name}' AS table_name, rid FROM {_t(name)} WHERE {where}" for i, (name, where) in enumerate(scans))


_LEAF_QUERIES = {
    "of_cte": (
        "WITH rich AS (SELECT c.c_nationkey FROM customer c WHERE c.c_acctbal > 9000) SELECT n.n_name, count(*) c FROM nation n JOIN rich ON n.n_nationkey = rich.c_nationkey WHERE n.n_regionkey = 1 GROUP BY n.n_name",
        _leaf_sql(("nation", "n_regionkey = 1"), ("customer", "c_acctbal > 9000")),
    ),
    "of_in_subquery": (
        "SELECT s.s_name FROM supplier s WHERE s.s_acctbal > 0 AND s.s_nationkey IN (SELECT n.n_nationkey FROM nation n WHERE n.n_regionkey = 2)",
        _leaf_sql(("supplier", "s_acctbal > 0"), ("nation", "n_regionkey = 2")),
    ),
    "of_any_case": ("SELECT N.n_name FROM nation n WHERE N.N_NATIONKEY < 3", _leaf_sql(("nation", "n_nationkey < 3"))),
    "of_outer_join": (
        "SELECT n.n_name, c.c_name FROM nation n LEFT JOIN customer c ON n.n_nationkey = c.c_nationkey AND c.c_acctbal > 9000 WHERE n.n_regionkey = 1 AND c.c_mktsegment IS NULL",
        _leaf_sql(("nation", "n_regionkey = 1"), ("customer", "c_acctbal > 9000")),
    ),
    "of_on_conjuncts": (
        "SELECT o.o_orderkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_nationkey = 3 AND o.o_totalprice > 100000",
        _leaf_sql(("orders", "o_totalprice > 100000"), ("customer", "c_nationkey = 3")),
    ),
    "of_in_list": (
        "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE n.n_regionkey IN (1, 2) AND r.r_name NOT IN ('ASIA', 'EUROPE')",
        _leaf_sql(("nation", "n_regionkey IN (1, 2)"), ("region", "r_name NOT IN ('ASIA', 'EUROPE')")),
    ),
    "of_like": (
        "SELECT c.c_custkey FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_name LIKE '%1_' AND c.c_mktsegment RLIKE '^(B|F)' AND c.c_name NOT LIKE '%9'",
        _leaf_sql(("customer", "regexp_matches(c_mktsegment, '^(B|F)') AND c_name NOT LIKE '%9'"), ("nation", "n_name LIKE '%1_'")),
    ),
    "of_between": (
        "SELECT o.o_orderkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_nationkey NOT BETWEEN 3 AND 20 WHERE o.o_totalprice BETWEEN 1000 AND 50000 AND o.o_orderdate BETWEEN DATE '1994-01-01' AND DATE '1996-12-31'",
        _leaf_sql(("orders", "o_totalprice BETWEEN 1000 AND 50000 AND o_orderdate BETWEEN DATE '1994-01-01' AND DATE '1996-12-31'"), ("customer", "c_nationkey NOT BETWEEN 3 AND 20")),
    ),
    "of_null_test": (
        "SELECT s.s_suppkey FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey AND n.n_name IS NOT NULL AND nullif(n.n_regionkey, 2) IS NULL WHERE nullif(s.s_nationkey % 3, 0) IS NULL AND s.`s_name` IS NOT NULL",
        _leaf_sql(("supplier", "nullif(s_nationkey % 3, 0) IS NULL AND s_name IS NOT NULL"), ("nation", "n_name IS NOT NULL AND nullif(n_regionkey, 2) IS NULL")),
    ),
    "of_lateral": (
        "SELECT n.n_name, x.k FROM nation n, LATERAL (SELECT count(*) AS k FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > 0) x WHERE n.n_regionkey IN (0, 3)",
        _leaf_sql(("nation", "n_regionkey IN (0, 3)"), ("supplier", "s_acctbal > 0")),
    ),
    "of_outer_filter": (
        "SELECT x.k, x.big FROM (SELECT c_nationkey + 1 AS k, c_acctbal AS big, c_mktsegment AS seg FROM customer) x WHERE x.k = 5 AND x.big > 100 AND upper(x.seg) LIKE 'B%'",
        _leaf_sql(("customer", "c_nationkey + 1 = 5 AND c_acctbal > 100 AND upper(c_mktsegment) LIKE 'B%'")),
    ),
    "of_derived_table": (
        "SELECT x.n_name, r.r_name FROM (SELECT n_name, n_regionkey FROM nation WHERE n_nationkey > 5) x JOIN region r ON x.n_regionkey = r.r_regionkey WHERE r.r_name <> 'ASIA'",
        _leaf_sql(("region", "r_name <> 'ASIA'"), ("nation", "n_nationkey > 5")),
    ),
}


def _questions(spark: SparkSession) -> DataFrame:
    rows = [(1, "How many customers are there per nation?"), (2, "Which part suppliers are late?"), (3, "hello"), (4, "Total price of orders"), (5, "Line items of each region's orders"), (6, "")]
    return spark.createDataFrame(rows, "id int, question string")


_QUESTIONS = "q AS (SELECT * FROM (VALUES (1, 'How many customers are there per nation?'), (2, 'Which part suppliers are late?'), (3, 'hello'), (4, 'Total price of orders'), (5, 'Line items of each region''s orders'), (6, '')) t(id, question))"
_ALIAS_ROWS = ", ".join(f"('{t}', '{a}')" for t, names in catalog.ALIASES.items() for a in names)
_EDGE_ROWS = ", ".join(f"('{t.name}', '{ref.split('.')[0]}')" for t in catalog.CATALOG.values() for ref in t.foreign_keys.values())

_TEXTS = ["[]", '{"result":{},"provenance":[]}', "nope", "[3]", '[{"result":{"a":1},"provenance":[["nation_1"]],"x":2}]', '[{"result":1,"provenance":[]}]', '[{"result":{},"provenance":"z"}]', '[{"result":{},"provenance":[[1]]}]', '[{"result":{},"provenance":[["nation_1"],["nation_2","region_1"]]}]']


def _text_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(_TEXTS)), "id int, text string")


def _l2_query(spark, sf_dir, batch: bool):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    if batch:
        queries = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec"))
        return retrieval.vector_top_k_batch(v, queries, 5).select("q_id", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))
    query = F.array(*[F.lit(float(x)) for x in v.where("vec_id = 0").first().embedding])
    return v, query


def _distances(spark, sf_dir):
    v, query = _l2_query(spark, sf_dir, False)
    return v.select("vec_id", F.round(retrieval.l2_squared(F.col("embedding"), query), 6).alias("distance"))


def _vector_topk(spark, sf_dir):
    v, query = _l2_query(spark, sf_dir, False)
    return retrieval.vector_top_k(v, query).select("vec_id", F.round("distance", 6).alias("distance"))


def _cells_topk(spark, sf_dir):
    """The nearest vectors from an index by cells, of which only those within reach are read."""
    v, path = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), tables.shared_folder(spark, "cells")
    cells.build_cells(v, path)
    return cells.Cells(spark, path).top_k([float(x) for x in v.where("vec_id = 0").first().embedding]).select("vec_id", F.round("distance", 6).alias("distance"))


def _hits(spark, sf_dir):
    """The nearest vectors as ranked row ids: a vector stands for the row of its number in one of six tables."""
    v, query = _l2_query(spark, sf_dir, False)
    top = retrieval.vector_top_k(v, query)
    name = F.element_at(F.array(*[F.lit(x) for x in ("customer", "orders", "part", "supplier", "nation", "region")]), (F.pmod("vec_id", F.lit(6)) + 1).cast("int"))
    ranked = top.select(F.row_number().over(retrieval.Window.orderBy("distance", "vec_id")).alias("rank"), F.concat(name, F.lit("_"), F.col("vec_id").cast("string")).alias("rid"))
    return ranked


def _capped(spark, sf_dir):
    index = tables.rid_index(_register(spark, sf_dir))
    return retrieval.capped(_hits(spark, sf_dir), index).select(F.col("rank").cast("long").alias("rank"), "table_name", "rid")


_L2 = "list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"
_TOP = f"SELECT v.vec_id, {_L2} AS d FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY d, v.vec_id LIMIT 40"


def _text_sql(table: str, columns: list[str]) -> str:
    return "concat_ws(' | ', " + ", ".join(f"CASE WHEN trim({c}::VARCHAR) <> '' THEN '{c}: ' || trim({c}::VARCHAR) END" for c in columns) + ")"


_NATION, _REGION, _CUSTOMER = ["n_nationkey", "n_name", "n_regionkey"], ["r_regionkey", "r_name"], ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]

_COLUMNS = {
    "region": _REGION,
    "nation": _NATION,
    "customer": _CUSTOMER,
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
}


def _fetch(t: dict[str, DataFrame]) -> DataFrame:
    return leaves.leaf_scan(t["nation"].sparkSession, "nation", ["n_name", "n_regionkey"], ["n_regionkey >= 1"])


def _explain(spark, t):
    df = sql_with_why(spark, "SELECT r.r_name, count(*) AS c FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name", tables=set(TABLES))
    rows = df.select(F.col("r_name").alias("id"), F.to_json(F.struct("r_name", "c")).alias("result"), F.col("why").alias("provenance"))
    return answers.explain_rows(rows, "How many nations has each region?", t)


def _relation(sql: str):
    """The provenance relation of a query, a witness set as text."""
    return _with_tables(lambda s, t: sql_with_why(s, sql, prov="rows", tables=set(TABLES)).withColumn(WHY, F.array_join(WHY, " AND ")))


_BY_REGION = "SELECT r.r_name, count(*) AS items, max(l.l_shipdate) AS latest FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name"


def _digest(spark, t):
    return sql_with_why(spark, SQL["flagship"][0], prov="count", tables=set(TABLES))


#: name -> (query, SQL or None)
OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "scan_tagged_nation": (_with_tables(lambda s, t: tables.tagged(t["nation"], "nation").withColumnRenamed(RID, "rid")), f"SELECT * FROM {N}"),
    "scan_tagged_lineitem": (_with_tables(lambda s, t: tables.tagged(t["lineitem"], "lineitem").select(F.col(RID).alias("rid"), "l_orderkey", "l_linenumber", "l_quantity")), f"SELECT rid, l_orderkey, l_linenumber, l_quantity FROM {L}"),
    "rid_index_counts": (
        _with_tables(lambda s, t: tables.rid_index(t).groupBy("table_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rid").alias("ids"))),
        f"SELECT table_name, count(*) AS n, count(DISTINCT rid) AS ids FROM ({_INDEX}) GROUP BY table_name",
    ),
    "resolve_rids": (_with_tables(_resolve), f"SELECT c.rid, i.table_name, i.rid IS NOT NULL AS found FROM ({_CANDIDATES}) c LEFT JOIN ({_INDEX}) i ON c.rid = i.rid"),
    "schema_catalog": (
        lambda s, d: catalog.catalog_frame(s).withColumn("position", F.col("position").cast("long")),
        "SELECT * FROM (VALUES " + ", ".join(f"('{t.name}', {i}::BIGINT, '{c}', {c in t.primary_key}, {repr(t.foreign_keys[c]) if c in t.foreign_keys else 'NULL'})" for t in catalog.CATALOG.values() for i, c in enumerate(t.columns)) + ") v(table_name, position, column_name, is_key, refers_to)",
    ),
    "index_docs": (
        _with_tables(lambda s, t: retrieval.index_documents(t, allow=["nation", "region"])),
        f"SELECT 'nation' AS table_name, {_RID['nation']} AS rid, {_text_sql('nation', _NATION)} AS text FROM nation UNION ALL SELECT 'region', {_RID['region']}, {_text_sql('region', _REGION)} FROM region",
    ),
    "index_docs_all": (
        _with_tables(lambda s, t: retrieval.index_documents(t)),
        " UNION ALL ".join(f"SELECT '{t}' AS table_name, {_RID[t]} AS rid, {_text_sql(t, _COLUMNS[t])} AS text FROM {t}" for t in TABLES),
    ),
    "row_to_text": (
        _with_tables(lambda s, t: t["customer"].select("c_custkey", retrieval.row_text(["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]).alias("text"))),
        f"SELECT c_custkey, {_text_sql('customer', ['c_custkey', 'c_name', 'c_nationkey', 'c_mktsegment'])} AS text FROM customer",
    ),
    "leaf_json": (
        _with_tables(lambda s, t: leaves.leaf_json(_fetch(t))),
        """SELECT '{"row_id":"nation_' || (n_nationkey + 1) || '","values":{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}}' AS leaf FROM nation WHERE n_regionkey >= 1""",
    ),
    "leaf_page": (
        _with_tables(lambda s, t: leaves.leaf_page(_fetch(t), 5, after="nation_15").withColumnRenamed(RID, "rid")),
        f"SELECT rid, n_name, n_regionkey FROM {N} WHERE n_regionkey >= 1 AND rid > 'nation_15' ORDER BY rid LIMIT 5",
    ),
    "leaf_page_by_key": (
        _with_tables(lambda s, t: leaves.leaf_page_by_key(s, "lineitem", ["l_orderkey", "l_linenumber", "l_shipdate"], ["l_quantity > 10"], 500, after="lineitem_1000_3").withColumnRenamed(RID, "rid")),
        f"SELECT rid, l_orderkey, l_linenumber, l_shipdate FROM {L} WHERE l_quantity > 10 AND (l_orderkey > 1000 OR (l_orderkey = 1000 AND l_linenumber > 3)) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice LIMIT 500",
    ),
    "vector_topk_cells": (_cells_topk, f"SELECT vec_id, round(d, 6) AS distance FROM ({_TOP})"),
    "vector_l2": (_distances, f"SELECT v.vec_id, round({_L2}, 6) AS distance FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"),
    "vector_topk": (_vector_topk, f"SELECT vec_id, round(d, 6) AS distance FROM ({_TOP})"),
    "topk_batch": (
        lambda s, d: _l2_query(s, d, True),
        f"SELECT q_id, vec_id, round(d, 6) AS distance, rank FROM (SELECT q.vec_id AS q_id, v.vec_id, {_L2} AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_L2}, v.vec_id) AS rank FROM embeddings v JOIN embeddings q ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id) WHERE rank <= 5",
    ),
    "retrieve_capped": (
        _capped,
        f"""WITH top AS ({_TOP}),
h AS (SELECT row_number() OVER (ORDER BY d, vec_id) AS rank, ['customer', 'orders', 'part', 'supplier', 'nation', 'region'][1 + vec_id % 6] || '_' || vec_id AS rid FROM top),
k AS (SELECT rank, rid, table_name, min(rank) OVER (PARTITION BY table_name) AS first FROM h JOIN ({_INDEX}) i USING (rid)),
t AS (SELECT *, dense_rank() OVER (ORDER BY first) AS table_no FROM k)
SELECT rank, table_name, rid FROM t WHERE table_no <= 4 ORDER BY rank LIMIT 10""",
    ),
    "schema_relevance": (
        lambda s, d: retrieval.relevant_tables(_questions(s)),
        f"""WITH {_QUESTIONS}, al(table_name, a) AS (VALUES {_ALIAS_ROWS}), ed(table_name, other) AS (VALUES {_EDGE_ROWS}),
n AS (SELECT DISTINCT id, table_name FROM q JOIN al ON instr(lower(question), a) > 0),
m AS (SELECT id FROM n GROUP BY id HAVING count(*) >= 2)
SELECT id, table_name FROM n UNION SELECT n.id, other FROM n JOIN m USING (id) JOIN ed USING (table_name)""",
    ),
    "last_user_message": (
        lambda s, d: retrieval.last_user_message(s.read.parquet(f"{d}/conversations.parquet")),
        "SELECT conv_id, trim(max_by(text, turn)) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id",
    ),
    "prov_formula": (
        _with_tables(lambda s, t: answers.formulas(_answers(s))),
        f"WITH {_ANSWERS} SELECT id, array_to_string(list_transform(p, lambda w: CASE WHEN len(w) = 1 THEN w[1] ELSE '(' || array_to_string(w, ' AND ') || ')' END), ' OR ') AS formula FROM f",
    ),
    "answer_json": (
        _with_tables(lambda s, t: answers.answer_rows(sql_with_why(s, "SELECT n.n_name, n.n_regionkey FROM nation n", tables=set(TABLES)))),
        """SELECT '{"result":{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '},"provenance":[["nation_' || (n_nationkey + 1) || '"]]}' AS answer FROM nation""",
    ),
    "json_is_array": (
        lambda s, d: _text_frame(s).select("id", answers.is_json_array(F.col("text")).alias("is_array")),
        "SELECT * FROM (VALUES " + ", ".join(f"({i}, {x.startswith('[')})" for i, x in enumerate(_TEXTS)) + ") t(id, is_array)",
    ),
    "parse_answer": (
        lambda s, d: answers.check_answers(_text_frame(s)),
        "SELECT * FROM (VALUES (0, NULL, NULL::BIGINT), (1, 'root not an array', -1), (2, 'invalid JSON', -1), (3, 'item not an object', 0), (4, 'wrong keys', 0), (5, 'result not an object', 0), (6, 'provenance not a list', 0), (7, 'id not a string', 0), (8, NULL, NULL)) t(id, problem, item)",
    ),
    "missing_ids": (
        _with_tables(lambda s, t: answers.missing_ids(_answers(s), t)),
        f"WITH {_ANSWERS} SELECT DISTINCT rid FROM (SELECT unnest(w) AS rid FROM s) WHERE rid NOT IN (SELECT rid FROM ({_INDEX}))",
    ),
    "validate_prov": (
        _with_tables(lambda s, t: answers.validate(_answers(s), t).withColumn("set_no", F.col("set_no").cast("long"))),
        f"""WITH {_ANSWERS},
u AS (SELECT id, set_no, unnest(w) AS rid FROM s),
d AS (SELECT id, set_no, row_number() OVER (PARTITION BY id, list_sort(w) ORDER BY set_no) AS k FROM s)
SELECT id, set_no, 'empty' AS problem, NULL::VARCHAR AS rid FROM s WHERE len(w) = 0
UNION ALL SELECT id, set_no, 'repeated id', NULL FROM s WHERE len(w) <> len(list_distinct(w))
UNION ALL SELECT id, set_no, 'unknown id', rid FROM u WHERE rid NOT IN (SELECT rid FROM ({_INDEX}))
UNION ALL SELECT id, set_no, 'repeated set', NULL FROM d WHERE k > 1""",
    ),
    "schema_subset": (
        _with_tables(lambda s, t: catalog.catalog_frame(s).join(_resolve(s, t).select("table_name").distinct(), "table_name", "left_semi").select("table_name", "column_name")),
        "SELECT * FROM (VALUES " + ", ".join(f"('{t.name}', '{c}')" for t in catalog.CATALOG.values() if t.name in ("nation", "region", "supplier") for c in t.columns) + ") v(table_name, column_name)",
    ),
    "prov_count": (
        _with_tables(_digest),
        f"SELECT r.r_name, n.n_name, count(*) AS items, CAST(sum(CAST(l.l_extendedprice * (1 - l.l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue, count(DISTINCT concat_ws(',', l.rid, o.rid, c.rid, n.rid, r.rid)) AS why FROM {L} l JOIN {O} o ON l.l_orderkey = o.o_orderkey JOIN {C} c ON o.o_custkey = c.c_custkey JOIN {N} n ON c.c_nationkey = n.n_nationkey JOIN {R} r ON n.n_regionkey = r.r_regionkey WHERE l.l_returnflag = 'R' GROUP BY r.r_name, n.n_name",
    ),
    "prov_rows_by_region": (
        _relation(_BY_REGION),
        f"SELECT DISTINCT r.r_name, count(*) OVER g AS items, max(l.l_shipdate) OVER g AS latest, array_to_string({_w('l.rid', 'o.rid', 'c.rid', 'n.rid', 'r.rid')}, ' AND ') AS why FROM {L} l JOIN {O} o ON l.l_orderkey = o.o_orderkey JOIN {C} c ON o.o_custkey = c.c_custkey JOIN {N} n ON c.c_nationkey = n.n_nationkey JOIN {R} r ON n.n_regionkey = r.r_regionkey WINDOW g AS (PARTITION BY r.r_name)",
    ),
    "prov_rows_nested": (
        _relation("SELECT x.n, count(*) AS nations FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 40) x JOIN nation ON x.k = n_nationkey WHERE EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = x.k) GROUP BY x.n"),
        f"SELECT DISTINCT x.n, count(DISTINCT a.n_nationkey) OVER (PARTITION BY x.n) AS nations, array_to_string({_w('c.rid', 'a.rid', 's.rid')}, ' AND ') AS why FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 40) x JOIN {C} c ON c.c_nationkey = x.k JOIN {N} a ON a.n_nationkey = x.k JOIN {S} s ON s.s_nationkey = x.k",
    ),
    "html_escape": (
        lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", html_escape(F.col("html")).alias("escaped")),
        "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;') AS escaped FROM pages",
    ),
    **{f"leaves_{name}": (_with_tables(lambda s, t, sql=sql: _leaf_ids(s, t, sql)), oracle) for name, (sql, oracle) in _LEAF_QUERIES.items()},
    "explain_text": (_with_tables(_explain), _EXPLAINED),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _sql_query(name) for name in SQL} | {name: run for name, (run, _) in OTHERS.items()}
ORACLES: dict[str, str] = {name: sql for name, (_, sql) in SQL.items()} | {name: sql for name, (_, sql) in OTHERS.items() if sql}
