"""Tables, answers, leaf scans, retrieval, logs and model hooks."""

import html
import time

import pytest
from pyspark.sql import functions as F

from whyframe.functions.text import html_escape
from whyframe.operators import answers, leaves, models, retrieval
from whyframe.sources import catalog, tables
from whyframe.sources.eventlog import EventLog
from whyframe.sources.tables import RID
from whyframe.streaming.eventlog import counts_by_window, log_stream

CSV = """nation_rownum|n_nationkey|n_name|n_comment
nation_1|0|ALGERIA                  | haggle
nation_2|1|A|x|EXTRA
nation_3|2|B
|3|C|norid
nation_5|4||emptyname
 nation_6 |5|D|"q ""dq"" z"
"""


def test_delimited_files(spark, tmp_path):
    (tmp_path / "nation.csv").write_text(CSV)
    got = {r[RID]: r for r in tables.read_delimited_folder(spark, f"file://{tmp_path}")["nation"].collect()}
    assert sorted(got) == ["nation_1", "nation_2", "nation_3", "nation_5", "nation_6"]
    assert got["nation_1"].n_name == "ALGERIA                  " and got["nation_1"].n_comment == " haggle"
    assert got["nation_2"].n_comment == "x" and got["nation_3"].n_comment is None
    assert got["nation_5"].n_name is None and got["nation_6"].n_comment == 'q "dq" z'


def test_delimited_files_need_the_id_column(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a|b\n1|2\n")
    with pytest.raises(ValueError, match="x_rownum"):
        tables.read_delimited_folder(spark, f"file://{tmp_path}")


def test_missing_folder_is_logged(spark, tmp_path):
    log = EventLog(spark, f"file://{tmp_path}/log")
    assert tables.read_delimited_folder(spark, f"file://{tmp_path}/none", log) == {}
    assert [r.type for r in log.read().collect()] == ["tables_missing"]


def test_log_appends_and_streams(spark, tmp_path):
    log = EventLog(spark, f"file://{tmp_path}/log")
    log.write({"type": "a", "x": "ä"}, {"type": "b"})
    log.write({"type": "a"})
    assert sorted(r.type for r in log.read().collect()) == ["a", "a", "b"] and all(r.ts > 1e9 for r in log.read().collect())
    query = counts_by_window(log_stream(spark, f"file://{tmp_path}/log")).writeStream.format("memory").queryName("log_counts").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert {r.type: r.n for r in spark.sql("SELECT type, sum(n) n FROM log_counts GROUP BY type").collect()} == {"a": 2, "b": 1}


def test_row_ids_and_resolution(spark):
    nation = spark.createDataFrame([(0, "A"), (1, "B")], "n_nationkey int, n_name string")
    index = tables.rid_index({"nation": nation})
    rids = spark.createDataFrame([("nation_2",), ("zzz_9",)], "rid string")
    got = {r.rid: r for r in tables.resolve(rids, index).collect()}
    assert got["nation_2"].row == {"n_nationkey": "1", "n_name": "B"} and got["zzz_9"].table_name is None


def test_catalog():
    assert len(catalog.CATALOG) == 8 and catalog.CATALOG["partsupp"].primary_key == ("ps_partkey", "ps_suppkey")
    assert list(catalog.schema_subset(["region", "nation", "x"])) == ["nation", "region"]


@pytest.mark.parametrize(("text", "problem"), [("[]", None), ('{"result":{},"provenance":[]}', "array"), ("nope", "invalid JSON"), (None, "invalid JSON"), ("[3]", "item 0"), ('[{"result":{"a":1},"provenance":[["nation_1"]],"x":2}]', "exactly"), ('[{"result":1,"provenance":[]}]', "object"), ('[{"result":{},"provenance":"z"}]', "list"), ('[{"result":{},"provenance":[[1]]}]', "strings"), ('[{"result":{},"provenance":[["nation_1"],["nation_2","region_1"]]}]', None)])
def test_parse_answer(text, problem):
    if problem is None:
        answers.parse_answer(text)
    else:
        with pytest.raises(answers.AnswerError, match=problem):
            answers.parse_answer(text)


def test_validation_collects_every_fault(spark):
    df = spark.createDataFrame([("a", [[]]), ("b", [["nation_1", "nation_1"]]), ("c", [["nation_1", "nation_2"], ["nation_2", "nation_1"], ["nation_1", "nation_2"]]), ("d", [["zzz_9"], ["nation_1", "zzz_9"]]), ("e", [["nation_1"]]), ("f", [])], "id string, provenance array<array<string>>")
    index = spark.createDataFrame([("nation_1",), ("nation_2",)], "rid string")
    got = sorted((r.id, r.set_no, r.problem, r.rid) for r in answers.validate(df, index).collect())
    assert got == [("a", 0, "empty", None), ("b", 0, "repeated id", None), ("c", 1, "repeated set", None), ("c", 2, "repeated set", None), ("d", 0, "unknown id", "zzz_9"), ("d", 1, "unknown id", "zzz_9")]
    assert [r.rid for r in answers.missing_ids(df, index).collect()] == ["zzz_9"]


def test_explanation(spark):
    df = spark.createDataFrame([("x", '{"n":1}', [["nation_1", "q_1"]]), ("y", "{}", [])], "id string, result string, provenance array<array<string>>")
    index = tables.rid_index({"nation": spark.createDataFrame([(0, " A ")], "n_nationkey int, n_name string")})
    got = {r.id: r.explanation for r in answers.explain_rows(df, "Who?", index).collect()}
    assert got["x"] == 'Question: Who?\nResult: {"n":1}\nProvenance, 1 derivation(s):\n- nation_1 (n_name A, n_nationkey 0) together with q_1 (unknown)'
    assert got["y"].endswith("- none")


def test_leaf_pages(spark):
    spark.createDataFrame([(i, f"N{i}") for i in range(12)], "n_nationkey int, n_name string").createOrReplaceTempView("nation")
    leaf, seen, last = leaves.leaf_scan(spark, "nation", ["n_name"], ["n_nationkey <> 3"]), [], None
    while page := [r[RID] for r in leaves.leaf_page(leaf, 5, last).collect()]:
        seen += page
        last = page[-1]
    assert len(seen) == len(set(seen)) == 11 and "nation_4" not in seen
    assert leaves.unseen(leaf, leaf.limit(4)).count() == 7
    assert leaves.leaf_json(leaf).count() == 11
    plan = leaf._jdf.queryExecution().optimizedPlan().toString()
    assert "n_nationkey" in plan


def test_retrieval_caps(spark):
    hits = spark.createDataFrame([(i + 1, rid) for i, rid in enumerate(["a_1", "zz", "b_1", "a_1", "c_1", "d_1", "e_1", "b_2", "a_2", "a_3"])], "rank long, rid string")
    index = spark.createDataFrame([(r, r[0]) for r in ["a_1", "a_2", "a_3", "b_1", "b_2", "c_1", "d_1", "e_1"]], "rid string, table_name string")
    got = [(r.rank, r.rid) for r in retrieval.capped(hits, index, max_rows=6, max_tables=4).orderBy("rank").collect()]
    assert got == [(1, "a_1"), (3, "b_1"), (5, "c_1"), (6, "d_1"), (8, "b_2"), (9, "a_2")]


def test_row_text_and_questions(spark):
    row = spark.createDataFrame([("r_1", " x ", None, "")], "t_rownum string, a string, b string, c string")
    assert row.select(retrieval.row_text(row.columns)).first()[0] == "a: x"
    with pytest.raises(ValueError):
        retrieval.index_documents({"nation": row}, allow=["region"])
    q = spark.createDataFrame([(1, "part suppliers"), (2, "Nations and customers"), (3, "")], "id int, question string")
    got = sorted((r.id, r.table_name) for r in retrieval.relevant_tables(q).collect())
    assert got == [(1, "nation"), (1, "part"), (1, "partsupp"), (1, "supplier"), (2, "customer"), (2, "nation"), (2, "region")]


def test_last_user_message(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 2, "user", " b "), (1, 3, "assistant", "c"), (2, 0, "system", "x")], "conv_id int, turn int, role string, text string")
    assert [tuple(r) for r in retrieval.last_user_message(df).collect()] == [(1, "b")]


def test_model_hook_tries_again():
    class Client:
        calls = 0

        def generate(self, prompt, temperature=0.0, timeout=0):
            self.calls += 1
            return "no" if self.calls < 2 else "[]"

    client = Client()
    assert models.ask_for_array(client, "q", tries=3) == "[]" and client.calls == 2
    assert models.ask_for_array(Client(), "q", tries=1) == "no"


def test_json_array_check(spark):
    df = spark.createDataFrame([("[1]",), ('{"a":1}',), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(answers.is_json_array(F.col("t"))).collect()] == [True, False, False, False]


def test_batched_search_in_blocks(spark):
    v = spark.createDataFrame([(i, [float(i), float(i % 3)]) for i in range(30)], "vec_id long, embedding array<double>")
    q = v.where("vec_id % 4 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec"))
    whole = sorted(map(tuple, retrieval.vector_top_k_batch(v, q, 3).collect()))
    assert len(whole) == 24 and whole == sorted(map(tuple, retrieval.vector_top_k_batch(v, q, 3, block=2).collect()))
    points = {i: (i, i % 3) for i in range(30)}
    for i in range(0, 30, 4):
        near = sorted((sum((a - b) ** 2 for a, b in zip(points[i], points[j])), j) for j in points if j != i)[:3]
        assert sorted(w[1] for w in whole if w[0] == i) == sorted(j for _, j in near)


def test_batched_search_holds_few_rows_a_task_and_ranks_as_spark_does(spark):
    rows = [(i, [float(i * i % 7), float(i % 5) / 3, -1.5]) for i in range(200)] + [(300, None), (301, [1.0, None, 2.0]), (302, [1.0]), (303, [float("nan"), 0.0, 0.0]), (304, [float("inf"), 0.0, 0.0]), (305, [2.0]), (None, [1.0, 1.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    q = v.where("vec_id % 50 = 0 OR vec_id = 302").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec"))
    scored = v.join(q, F.col("vec_id") != F.col("q_id")).select("q_id", "vec_id", retrieval.l2_squared(F.col("embedding"), F.col("q_vec")).alias("distance"))
    want = scored.withColumn("rank", F.row_number().over(retrieval.Window.partitionBy("q_id").orderBy("distance", "vec_id"))).where("rank <= 9")
    for block in (4096, 2):
        got = retrieval.vector_top_k_batch(v, q, 9, block=block)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    plan = retrieval.vector_top_k_batch(v, q, 9)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan  # no row for each vector and query


def test_equal_sets_are_found_without_comparing_all_pairs(spark):
    sets = [[f"nation_{i % 12000}", "region_1"] if i % 3 else ["region_1", f"nation_{i % 12000}"] for i in range(24000)]
    df = spark.createDataFrame([(1, sets)], "id int, provenance array<array<string>>")
    index = spark.createDataFrame([(f"nation_{i}",) for i in range(12000)] + [("region_1",)], "rid string")
    start = time.monotonic()
    got = answers.validate(df, index)
    assert "array_position" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.set_no for r in got.collect()) == list(range(12000, 24000)) and time.monotonic() - start < 60


def test_every_try_is_noted_and_later_ones_carry_a_hint():
    prompts, notes = [], []

    class Client:
        def generate(self, prompt, temperature=0.0, timeout=0):
            prompts.append(prompt)
            return "no" if len(prompts) < 2 else "[]"

    models.ask_for_array(Client(), "q", tries=3, note=lambda kind, **fields: notes.append((kind, fields["attempt"], fields["ok_json_array"])))
    assert prompts == ["q", f"q\n\n{models.HINT}"] and notes == [("attempt", 1, False), ("attempt", 2, True)]


def test_index_is_saved_loaded_and_built_again(spark, tmp_path):
    nation = spark.createDataFrame([(0, "A"), (1, "B")], "n_nationkey int, n_name string")
    path, notes = f"file://{tmp_path}/index", []
    note = lambda kind, **fields: notes.append(kind)
    build = lambda: retrieval.index_documents({"nation": nation})
    first = sorted(map(tuple, retrieval.load_or_build(spark, path, build, note).collect()))
    assert first == sorted(map(tuple, retrieval.load_or_build(spark, path, lambda: 1 / 0, note).collect())) and len(first) == 2
    spark.range(3).write.mode("overwrite").parquet(path)  # not an index
    assert retrieval.load_or_build(spark, path, build, note).count() == 2
    assert notes == ["index_not_loaded", "index_built", "index_loaded", "index_not_loaded", "index_built"]
    with pytest.raises(ValueError):
        retrieval.save_index(retrieval.index_documents({"nation": nation.where("false")}), path)


def test_ids_are_pushed_as_keys(spark, tmp_path):
    spark.range(1000).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey").write.parquet(f"{tmp_path}/orders")
    spark.range(10).selectExpr("id AS l_orderkey", "1 AS l_linenumber", "id AS l_partkey").write.parquet(f"{tmp_path}/lineitem")
    data = {t: spark.read.parquet(f"{tmp_path}/{t}") for t in ("orders", "lineitem")}
    found = tables.look_up(data, ["orders_5", "orders_x", "orders_5000", "lineitem_3_1_3", "nation_1"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(o_orderkey, [4,4999])" in plan and "EqualTo(l_orderkey,3)" in plan and "Exchange" not in plan
    assert sorted(r.rid for r in found.collect()) == ["lineitem_3_1_3", "orders_5"]
    assert tables.look_up(data, ["nation_1", "part_2"]) is None
    few = spark.createDataFrame([(1, [["orders_5"], ["orders_0"]])], "id int, provenance array<array<string>>")
    missing = answers.missing_ids(few, tables.rid_index(data))
    assert [r.rid for r in missing.collect()] == ["orders_0"] and "row" not in missing.columns


def test_html_escape(spark):
    text = """<a href="x">R&D &amp; 'q'</a>"""
    assert spark.range(1).select(html_escape(F.lit(text))).first()[0] == html.escape(text)


def test_ids_are_resolved_by_typed_keys(spark, tmp_path):
    """As over the index of texts, for whole columns of ids, odd ones among them."""
    spark.range(50).selectExpr("id AS n_nationkey", "concat('N', id) AS n_name").write.parquet(f"{tmp_path}/nation")
    spark.range(400).selectExpr("id div 4 AS l_orderkey", "id % 4 AS l_linenumber", "CAST(id * 7 AS int) AS l_partkey", "1 AS l_suppkey", "id / 8 AS l_quantity", "id * 1.25D AS l_extendedprice", "'c' AS l_comment").write.parquet(f"{tmp_path}/lineitem")
    data = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in ("nation", "lineitem")}
    data["region"] = spark.createDataFrame([("region_1", 0, "A"), (" region_x ", 1, "B"), (None, 2, "C"), ("", 3, "D")], "region_rownum string, r_regionkey int, r_name string")
    data["own"] = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    data["customer"] = spark.createDataFrame([(None, "lost"), (-5, "kept")], "c_custkey int, c_name string")
    index = tables.rid_index(data)
    every = [r.rid for r in index.select("rid").collect()]
    odd = ["nation_01", "nation_0", "nation_51", "nation_", "nation", "nation_1_2", "nation_1 ", "nation_9223372036854775808", "nation_99999999999999999999", "lineitem_0_0_0_1_0", "lineitem_0_0_0_1_0_1", "region_2", "region_", "", "customer_-4", "customer_null", "zzz_1", "_", "own_1"]
    rids = spark.createDataFrame([(r,) for r in every + odd + odd[:3] + [None]], "rid string")
    told = lambda df: sorted(((r.rid, r.table_name, tuple(sorted(r.row.items(), key=str)) if r.row else None) for r in df.collect()), key=str)
    assert told(tables.resolve(rids, data)) == told(tables.resolve(rids, index))
    assert sorted(r.rid for r in tables.known_ids(rids, data).collect()) == sorted(set(every))
    given = spark.createDataFrame([(1, [["nation_1", "nation_77"], ["lineitem_0_0_0_1_0_0"]]), (2, [["zzz_9", "region_1"], []])], "id int, provenance array<array<string>>")
    assert sorted(r.rid for r in answers.missing_ids(given, data).collect()) == ["nation_77", "zzz_9"]
    assert sorted(map(tuple, answers.validate(given, data).collect()), key=str) == sorted(map(tuple, answers.validate(given, index).collect()), key=str)


def test_typed_keys_build_no_texts_of_table_rows(spark, tmp_path):
    spark.range(50).selectExpr("id AS o_orderkey", "concat('c', id) AS o_comment").write.parquet(f"{tmp_path}/orders")
    data = {"orders": spark.read.parquet(f"{tmp_path}/orders")}
    asked = spark.createDataFrame([("orders_1",), ("orders_99",)], "rid string")
    plan = tables.known_ids(asked, data)._jdf.queryExecution()
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan.executedPlan().toString() and "orders_" not in plan.optimizedPlan().toString()
    found = tables.find_rows(asked, data)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(i for i, line in enumerate(found) if "Join" in line)
    assert not any("map_from_entries" in line for line in found[join:]) and any("map_from_entries" in line for line in found[:join])
