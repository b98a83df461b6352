"""Provenance of SQL queries over small tables: fixed cases and general properties."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from whyframe.functions import why
from whyframe.operators.provenance import sql_with_why
from whyframe.plans.catalyst import Catalyst
from whyframe.sources.tables import register

TABLES = {"region", "nation"}
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
NATION_REGION = [0, 1, 1, 1, 4, 0, 3, 3, 2, 2, 4, 4, 2, 4, 0, 0, 0, 1, 2, 3, 4, 2, 3, 3, 1]


@pytest.fixture
def tables(spark):
    nations = [(f"nation_{i + 1}", i, f"N{i}", r) for i, r in enumerate(NATION_REGION)]
    regions = [(f"region_{i + 1}", i, n.ljust(25)) for i, n in enumerate(REGIONS)]
    register(spark, {"nation": spark.createDataFrame(nations, "nation_rownum string, n_nationkey int, n_name string, n_regionkey int"), "region": spark.createDataFrame(regions, "region_rownum string, r_regionkey int, r_name string")})


def rows(spark, sql, **options):
    return {tuple(r)[:-1]: r.why for r in sql_with_why(spark, sql, tables=TABLES, **options).collect()}


def test_grouped_join(spark, tables):
    got = rows(spark, "SELECT r.r_name, COUNT(*) c FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name")
    assert got[("AFRICA".ljust(25), 5)] == [[n, "region_1"] for n in ("nation_1", "nation_15", "nation_16", "nation_17", "nation_6")]
    assert got[("EUROPE".ljust(25), 5)] == [[n, "region_4"] for n in ("nation_20", "nation_23", "nation_24", "nation_7", "nation_8")]


def test_self_join_keeps_one_id(spark, tables):
    assert rows(spark, "SELECT a.n_name FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey WHERE a.n_nationkey = 3") == {("N3",): [["nation_4"]]}


def test_outer_join_keeps_the_preserved_side(spark, tables):
    got = rows(spark, "SELECT r.r_name, n.n_name FROM region r LEFT JOIN nation n ON r.r_regionkey = n.n_regionkey AND n.n_nationkey = 0")
    assert got[("AFRICA".ljust(25), "N0")] == [["nation_1", "region_1"]]
    assert got[("ASIA".ljust(25), None)] == [["region_3"]]


def test_aggregate_over_an_aggregate(spark, tables):
    got = rows(spark, "SELECT max(c) FROM (SELECT n_regionkey k, count(*) c FROM nation WHERE n_nationkey < 2 GROUP BY n_regionkey) x JOIN region ON k = r_regionkey")
    assert got == {(1,): [["nation_1", "region_1"], ["nation_2", "region_2"]]}


def test_empty_global_aggregate(spark, tables):
    assert rows(spark, "SELECT count(*) FROM nation WHERE n_nationkey < 0") == {(0,): []}


def test_count_distinct_stays_distinct(spark, tables):
    assert list(rows(spark, "SELECT count(DISTINCT n_regionkey) FROM nation")) == [(5,)]


def test_intersect_matches_nulls(spark, tables):
    got = rows(spark, "SELECT nullif(n_regionkey, 0) k FROM nation WHERE n_nationkey < 2 INTERSECT SELECT nullif(r_regionkey, 0) FROM region WHERE r_regionkey < 2")
    assert got == {(None,): [["nation_1", "region_1"]], (1,): [["nation_2", "region_2"]]}


def test_intersect_orders_its_pairs_once(spark, tables):
    """The product is in canonical form; a second ordering would copy every pair of a group again."""
    sql = "SELECT n_regionkey k FROM nation WHERE n_nationkey < 12 INTERSECT SELECT n_regionkey FROM nation WHERE n_nationkey > 11"
    got = rows(spark, sql)
    assert all(p == sorted(sorted(set(w)) for w in p) and len(p) == len({tuple(w) for w in p}) for p in got.values())
    plan = sql_with_why(spark, sql)._jdf.queryExecution().analyzed().toString()
    assert plan.count("array_union") == 1 and plan.count("get(lambda") == 1, plan


def test_intersect_writes_its_formula_without_an_array_of_all_pairs(spark, tables):
    """The registered query's text; a plan with the array of pairs fails by memory where the text alone would not."""
    sql = "SELECT n_regionkey k FROM nation WHERE n_nationkey < 18 INTERSECT SELECT n_regionkey FROM nation WHERE n_nationkey > 5 ORDER BY k"
    text, whole = sql_with_why(spark, sql, prov="formula", tables=TABLES), sql_with_why(spark, sql, tables=TABLES)
    assert text.collect() == whole.withColumn("why", why.formula(F.col("why"))).collect()
    c = Catalyst(spark)
    kinds = lambda df: {e.dataType().simpleString() for x in c.walk(c.plan_of(df)) if x.nodeName() == "Project" for e in c.items(x.projectList()) if e.nodeName() == "Alias"}
    assert "array<array<string>>" in kinds(whole) and "array<array<string>>" not in kinds(text)


SIDES = st.lists(st.sampled_from([[], ["a"], ["a", "b"], ["a", "c"], ["b"], ["b", "d"], ["c"], ["d"], ["\u00e9"]]), max_size=6).map(lambda x: sorted(map(list, {tuple(w) for w in x})))


@given(st.lists(st.tuples(SIDES, SIDES), min_size=1, max_size=20), st.sampled_from([1, 3, 10, 1000]))
@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_formula_of_times(spark, sides, pairs):
    """Ranges of any width give the text of the whole product, also with empty, shared and missing sets."""
    df = spark.createDataFrame(sides, "p array<array<string>>, q array<array<string>>")
    p, q = F.col("p"), F.col("q")
    for r in df.select("p", "q", why.formula(why.times(p, q)).alias("want"), why.formula_of_times(p, q, pairs).alias("got")).collect():
        assert r.got == r.want, r


def test_constants_have_the_empty_witness(spark, tables):
    assert rows(spark, "SELECT 1 AS x") == {(1,): [[]]}


def test_modes(spark, tables):
    sql = "SELECT n_regionkey k, count(*) c FROM nation GROUP BY n_regionkey"
    assert set(rows(spark, sql, prov="count").values()) == {5}
    digests = rows(spark, sql, prov="digest")
    assert len(set(digests.values())) == 5 and digests == rows(spark, sql, prov="digest")
    plain = sql_with_why(spark, sql, prov="off")
    assert plain.columns == ["k", "c"]
    assert "__w" not in plain._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(ValueError):
        sql_with_why(spark, sql, prov="some")


def test_set_operations_that_keep_duplicates_are_refused(spark, tables):
    with pytest.raises(NotImplementedError):
        sql_with_why(spark, "SELECT n_regionkey FROM nation INTERSECT ALL SELECT r_regionkey FROM region", tables=TABLES)


def test_formula(spark):
    df = spark.createDataFrame([(1, [["nation_1"], ["nation_2", "region_1"]]), (2, [[]]), (3, [])], "i int, p array<array<string>>")
    got = {r.i: r.f for r in df.select("i", why.formula(F.col("p")).alias("f")).collect()}
    assert got == {1: "nation_1 OR (nation_2 AND region_1)", 2: "()", 3: ""}


def test_times_and_canonical(spark):
    df = spark.createDataFrame([([["b"], ["a"]], [["c"], ["a"]])], "p array<array<string>>, q array<array<string>>")
    row = df.select(why.canonical(why.times(F.col("p"), F.col("q"))).alias("x")).first()
    assert row.x == [["a"], ["a", "b"], ["a", "c"], ["b", "c"]]


QUERIES = [
    "SELECT a.n_name, b.r_name FROM nation a JOIN region b ON a.n_regionkey = b.r_regionkey",
    "SELECT DISTINCT a.n_regionkey FROM nation a JOIN region b ON a.n_regionkey = b.r_regionkey",
    "SELECT n_regionkey FROM nation UNION SELECT r_regionkey FROM region",
    "SELECT DISTINCT a.n_regionkey FROM nation a JOIN nation b ON a.n_nationkey = b.n_regionkey",
]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6))
def test_witness_sets_are_sufficient_and_deleting_them_all_is_fatal(spark, seed):
    rng = random.Random(seed)
    nations = [(f"nation_{i}", i, f"N{rng.randrange(3)}", rng.randrange(4)) for i in range(6)]
    regions = [(f"region_{i}", i, f"R{i}") for i in rng.sample(range(4), 3)]

    def load(keep):
        register(spark, {"nation": spark.createDataFrame([r for r in nations if keep(r[0])], "nation_rownum string, n_nationkey int, n_name string, n_regionkey int"), "region": spark.createDataFrame([r for r in regions if keep(r[0])], "region_rownum string, r_regionkey int, r_name string")})

    sql = QUERIES[seed % len(QUERIES)]
    load(lambda r: True)
    full = sql_with_why(spark, sql, tables=TABLES).collect()
    assert sorted(map(str, (tuple(r) for r in spark.sql(sql).collect()))) == sorted(str(tuple(r)[:-1]) for r in full)
    for r in full[:2]:
        target = tuple(r)[:-1]
        witness = set(r.why[0])
        load(lambda x: x in witness)
        assert target in {tuple(x) for x in spark.sql(sql).collect()}
        gone = {w[0] for w in r.why}
        others = [x for x in full if tuple(x)[:-1] == target]
        gone |= {w[0] for x in others for w in x.why}
        load(lambda x: x not in gone)
        assert target not in {tuple(x) for x in spark.sql(sql).collect()}


def test_table_names_in_any_case(spark, tables):
    register(spark, {"Nation": spark.table("nation")})
    got = sql_with_why(spark, "SELECT n_name FROM NATION x WHERE n_nationkey = 3", tables={"Nation"}).collect()
    assert [r.why for r in got] == [[["nation_4"]]]


def test_made_up_names_give_no_ids(spark, tables):
    for sql in ("SELECT n_nationkey FROM VALUES (1), (2) AS nation(n_nationkey)", "WITH nation AS (SELECT 1 AS n_nationkey) SELECT n_nationkey FROM nation", "SELECT id FROM range(3) nation"):
        assert all(r.why == [[]] for r in sql_with_why(spark, sql, tables=TABLES).collect()), sql
    got = sql_with_why(spark, "SELECT n_name FROM (SELECT r_name AS n_name FROM region WHERE r_regionkey = 1) nation", tables=TABLES).collect()
    assert [r.why for r in got] == [[["region_2"]]]


def test_tables_without_ids_are_refused(spark, tables, tmp_path):
    spark.table("nation").write.parquet(f"{tmp_path}/n")
    with pytest.raises(NotImplementedError):
        sql_with_why(spark, f"SELECT n_name FROM parquet.`{tmp_path}/n`", tables=TABLES)


def test_a_column_named_why_is_refused(spark, tables):
    with pytest.raises(ValueError):
        sql_with_why(spark, "SELECT n_name, 'x' AS Why FROM nation", tables=TABLES)


SUMMARISED = [
    "SELECT n_name FROM nation WHERE n_nationkey < 3",
    "SELECT r.r_name, count(*) c FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name HAVING count(*) > 2 ORDER BY 1",
    "SELECT DISTINCT n_regionkey FROM nation",
    "SELECT count(DISTINCT n_name) c, sum(n_nationkey) s FROM nation",
    "SELECT count(*) c FROM nation WHERE n_nationkey < 0",
    "SELECT n_regionkey, r_name, count(*) c FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (n_regionkey, r_name)",
    "SELECT c, count(*) n FROM (SELECT n_regionkey, count(*) c FROM nation GROUP BY 1) x GROUP BY c",
    "SELECT r_name FROM region UNION SELECT n_name FROM nation",
    "SELECT r_name, count(*) c FROM region LEFT JOIN nation ON r_regionkey = n_regionkey AND n_nationkey < 4 GROUP BY r_name",
]


def test_counts_and_digests_say_what_the_sets_say(spark, tables):
    for sql in SUMMARISED:
        full = {tuple(r)[:-1]: r.why for r in sql_with_why(spark, sql, tables=TABLES).collect()}
        counts = {tuple(r)[:-1]: r.why for r in sql_with_why(spark, sql, "count", TABLES).collect()}
        assert counts == {k: len(v) for k, v in full.items()}, sql
        digests = {tuple(r)[:-1]: r.why for r in sql_with_why(spark, sql, "digest", TABLES).collect()}
        same = {}
        for k, v in full.items():
            same.setdefault(tuple(map(tuple, v)), set()).add(digests[k])
        assert all(len(v) == 1 for v in same.values()) and len({*map(tuple, same.values())}) == len(same), sql


def test_digests_don_t_depend_on_the_plan(spark, tables):
    """The same witnesses summed with and without sets."""
    flat = sql_with_why(spark, "SELECT n_regionkey k FROM nation GROUP BY n_regionkey", "digest", TABLES)
    sets = sql_with_why(spark, "SELECT DISTINCT k FROM (SELECT DISTINCT n_regionkey k FROM nation)", "digest", TABLES)
    assert {tuple(r) for r in flat.collect()} == {tuple(r) for r in sets.collect()}


def test_counts_and_digests_collect_no_sets(spark, tables):
    for mode in ("count", "digest"):
        plan = sql_with_why(spark, SUMMARISED[1], mode, TABLES)._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_set" not in plan and "collect_list" not in plan


def test_large_groups_take_no_pairwise_comparison(spark):
    sets = spark.range(60_000).selectExpr("array(concat('a', id % 40000), 'b') AS w").agg(F.collect_list("w").alias("p"))
    got = sets.select(why.canonical(F.col("p")).alias("p")).first().p
    assert [tuple(w) for w in got] == sorted((f"a{i}", "b") for i in range(40_000))
    odd = spark.createDataFrame([(None,), ([],), ([["b", "a"], ["a", "b"], []],)], "p array<array<string>>")
    assert [r[0] for r in odd.select(why.canonical(F.col("p"))).collect()] == [None, [], [[], ["a", "b"]]]


CORRELATED = [
    ("SELECT r_name, (SELECT max(n_nationkey) FROM nation WHERE n_regionkey = r_regionkey) m FROM region WHERE r_regionkey < 2", {("AFRICA".ljust(25), 16): [["region_1"]], ("AMERICA".ljust(25), 24): [["region_2"]]}),
    ("SELECT r_regionkey, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey < 2) c FROM region", {(0, 1): [["region_1"]], (1, 1): [["region_2"]], (2, 0): [["region_3"]], (3, 0): [["region_4"]], (4, 0): [["region_5"]]}),
    ("SELECT n_name FROM nation n WHERE n_nationkey = (SELECT min(m.n_nationkey) FROM nation m WHERE m.n_regionkey = n.n_regionkey AND m.n_nationkey > 20)", {("N21",): [["nation_22"]], ("N22",): [["nation_23"]], ("N24",): [["nation_25"]]}),
    ("SELECT n_regionkey, count(*) c FROM nation GROUP BY n_regionkey HAVING n_regionkey = (SELECT max(r_regionkey) FROM region WHERE r_regionkey <= n_regionkey) AND n_regionkey < 1", {(0, 5): [["nation_1"], ["nation_15"], ["nation_16"], ["nation_17"], ["nation_6"]]}),
]


@pytest.mark.parametrize(("sql", "expected"), CORRELATED)
def test_correlated_scalar_subqueries_keep_the_outer_row(spark, tables, sql, expected):
    assert rows(spark, sql) == expected


MATCHES = [
    ("SELECT n_name FROM nation n WHERE n_nationkey = 2 AND EXISTS (SELECT 1 FROM region r WHERE r.r_regionkey < n.n_regionkey + 1)", {("N2",): [["nation_3", "region_1"], ["nation_3", "region_2"]]}),
    ("SELECT r_regionkey FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey < 3) OR r_regionkey = 4", {(0,): [["nation_1", "region_1"]], (1,): [["nation_2", "region_2"], ["nation_3", "region_2"]], (4,): [["region_5"]]}),
    ("SELECT r_regionkey FROM region r WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey < 8) OR r_regionkey = 3", {(2,): [["region_3"]], (3,): [["region_4"]]}),
    ("SELECT r_regionkey, r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey = 0) y FROM region WHERE r_regionkey < 2", {(0, True): [["nation_1", "region_1"]], (1, False): [["region_2"]]}),
    ("SELECT k FROM (SELECT n_regionkey k FROM nation WHERE n_nationkey < 2 GROUP BY n_regionkey) x WHERE EXISTS (SELECT 1 FROM region WHERE r_regionkey > k + 3)", {(0,): [["nation_1", "region_5"]]}),
    ("SELECT r_regionkey, p FROM region LATERAL VIEW explode(array(1, 2)) t AS p WHERE r_regionkey = 1 AND EXISTS (SELECT 1 FROM nation WHERE n_nationkey < p AND n_nationkey < 2)", {(1, 1): [["nation_1", "region_2"]], (1, 2): [["nation_1", "region_2"], ["nation_2", "region_2"]]}),
    ("FROM nation |> WHERE n_nationkey < 2 |> AGGREGATE count(*) AS c", {(2,): [["nation_1"], ["nation_2"]]}),
    ("SELECT r_regionkey, x.n_name FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey < 2) x", {(0, "N0"): [["nation_1", "region_1"]], (1, "N1"): [["nation_2", "region_2"]]}),
]


@pytest.mark.parametrize(("sql", "expected"), MATCHES)
def test_matches_by_any_condition(spark, tables, sql, expected):
    assert rows(spark, sql) == expected


#: Nations as a tree, each under the one whose key is a third of its own.
TREE = "WITH RECURSIVE t(k, d) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey = 1 UNION ALL SELECT n.n_nationkey, d + 1 FROM t JOIN nation n ON n.n_nationkey DIV 3 = t.k{}) "
RECURSIVE = [
    (TREE.format("") + "SELECT k FROM t WHERE k IN (1, 4, 13)", {(1,): [["nation_2"]], (4,): [["nation_2", "nation_5"]], (13,): [["nation_14", "nation_2", "nation_5"]]}),
    (TREE.format("") + "SELECT d, count(*) c FROM t WHERE d < 2 GROUP BY d", {(0, 1): [["nation_2"]], (1, 3): [["nation_2", "nation_4"], ["nation_2", "nation_5"], ["nation_2", "nation_6"]]}),
    (TREE.format(" WHERE n.n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey = 4)") + "SELECT DISTINCT k FROM t", {(1,): [["nation_2"]], (4,): [["nation_2", "nation_5", "region_5"]], (13,): [["nation_14", "nation_2", "nation_5", "region_5"]]}),
    (TREE.format("") + "SELECT a.k, b.k j FROM t a JOIN t b ON a.k = b.k + 1 WHERE a.k < 5", {(4, 3): [["nation_2", "nation_4", "nation_5"]]}),
    ("WITH RECURSIVE s(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM s WHERE i < 4) SELECT i FROM s", {(i,): [[]] for i in (1, 2, 3, 4)}),
    ("WITH RECURSIVE s(i) AS (SELECT 22 UNION ALL SELECT i + 1 FROM s WHERE i < 30) SELECT i FROM s JOIN nation ON n_nationkey = i", {(22,): [["nation_23"]], (23,): [["nation_24"]], (24,): [["nation_25"]]}),
    (TREE.format("").replace("= 1 UNION", "> 99 UNION") + "SELECT k FROM t", {}),
    ("WITH RECURSIVE t(k, d) AS (SELECT c, 0 FROM (SELECT n_regionkey c, count(*) FROM nation WHERE n_nationkey < 3 GROUP BY 1) UNION ALL SELECT r_regionkey, d + 1 FROM t JOIN region ON r_regionkey = k + 3 WHERE d < 1) SELECT k FROM t", {(0,): [["nation_1"]], (1,): [["nation_2"], ["nation_3"]], (3,): [["nation_1", "region_4"]], (4,): [["nation_2", "region_5"], ["nation_3", "region_5"]]}),
]


@pytest.mark.parametrize(("sql", "expected"), RECURSIVE)
def test_recursion_multiplies_along_the_derivation(spark, tables, sql, expected):
    assert rows(spark, sql) == expected
    counts = {tuple(r)[:-1]: r.why for r in sql_with_why(spark, sql, "count", TABLES).collect()}
    assert counts == {k: len(v) for k, v in expected.items()}


def test_recursion_without_end_and_matches_without_a_rule_are_refused(spark, tables):
    with pytest.raises(Exception, match="RECURSION_LEVEL_LIMIT"):
        sql_with_why(spark, "WITH RECURSIVE t(k) AS (SELECT r_regionkey FROM region UNION ALL SELECT (k + 1) % 5 FROM t) SELECT k FROM t", tables=TABLES).collect()
    with pytest.raises(NotImplementedError):
        sql_with_why(spark, TREE.format(" WHERE EXISTS (SELECT 1 FROM region WHERE r_regionkey < n.n_regionkey)") + "SELECT k FROM t", tables=TABLES)


RELATION = [*SUMMARISED, *[q for q, _ in RECURSIVE[:7]], *[q for q, _ in CORRELATED], *[q for q, _ in MATCHES], "SELECT n_regionkey FROM nation INTERSECT SELECT r_regionkey FROM region WHERE r_regionkey < 3", "SELECT r_regionkey FROM region EXCEPT SELECT n_nationkey FROM nation WHERE n_nationkey < 2", "SELECT DISTINCT k FROM (SELECT n_regionkey k, count(*) c FROM nation GROUP BY 1 UNION ALL SELECT r_regionkey, 1 FROM region) x", "SELECT 1 AS x"]


def test_the_relation_holds_the_sets(spark, tables):
    for sql in RELATION:
        full = {(tuple(r)[:-1], tuple(w)) for r in sql_with_why(spark, sql, tables=TABLES).collect() for w in r.why}
        got = [(tuple(r)[:-1], tuple(r.why)) for r in sql_with_why(spark, sql, "rows", TABLES).collect()]
        assert set(got) == full and ("GROUP BY" not in sql or len(got) == len(full)), sql


def test_the_relation_moves_no_witnesses_where_ids_stand_once(spark, tmp_path):
    """Few groups are sent to their rows, rows with many matches are dealt out first, and no DISTINCT follows; with an id twice it does."""
    nested = "SELECT x.n, count(*) c FROM (SELECT c_nationkey k, count(*) n FROM customer GROUP BY c_nationkey HAVING count(*) > 1) x JOIN nation ON x.k = n_nationkey WHERE EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = x.k) GROUP BY x.n"
    spark.range(3).selectExpr("id n_nationkey", "concat('N', id) n_name").write.parquet(f"{tmp_path}/nation")
    spark.range(40).selectExpr("id c_custkey", "id % 4 c_nationkey").write.parquet(f"{tmp_path}/customer")
    spark.range(30).selectExpr("id s_suppkey", "id % 5 s_nationkey").write.parquet(f"{tmp_path}/once")
    spark.range(30).selectExpr("id div 2 s_suppkey", "id div 2 % 5 s_nationkey").write.parquet(f"{tmp_path}/twice")
    names = {"nation": "nation", "customer": "customer", "supplier": "once"}
    for name, folder in names.items():
        spark.read.parquet(f"{tmp_path}/{folder}").createOrReplaceTempView(name)
    df = sql_with_why(spark, nested, "rows", set(names))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and "RepartitionByExpression" in plan and not plan.lstrip().startswith("Aggregate")
    full = sorted((*tuple(r)[:-1], tuple(w)) for r in sql_with_why(spark, nested, tables=set(names)).collect() for w in r.why)
    assert sorted((*tuple(r)[:-1], tuple(r.why)) for r in df.collect()) == full and len(full) == 180
    spark.read.parquet(f"{tmp_path}/twice").createOrReplaceTempView("supplier")
    again = sql_with_why(spark, nested, "rows", set(names))
    assert again._jdf.queryExecution().optimizedPlan().toString().lstrip().startswith("Aggregate")
    full = sorted((*tuple(r)[:-1], tuple(w)) for r in sql_with_why(spark, nested, tables=set(names)).collect() for w in r.why)
    assert sorted((*tuple(r)[:-1], tuple(r.why)) for r in again.collect()) == full


def test_the_relation_gathers_no_sets(spark, tables):
    df = sql_with_why(spark, "SELECT r_name, count(*) c FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", "rows", TABLES)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_" not in plan and dict(df.dtypes)["why"] == "array<string>"


def test_the_relation_refuses_to_count_witnesses_as_rows(spark, tables):
    for tail in ("ORDER BY k LIMIT 2", "LIMIT 2 OFFSET 1"):
        with pytest.raises(NotImplementedError):
            sql_with_why(spark, f"SELECT n_regionkey k, count(*) c FROM nation GROUP BY n_regionkey {tail}", "rows", TABLES)
    assert len(sql_with_why(spark, "SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 2", "rows", TABLES).collect()) == 2
