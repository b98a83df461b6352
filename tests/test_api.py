"""The engine's front end to end over small tables."""

import json

import pytest
from pyspark.sql import functions as F

from whyframe.api import Engine, RequestError
from whyframe.sources.eventlog import EventLog


@pytest.fixture
def engine(spark, tmp_path):
    nation = spark.createDataFrame([(f"nation_{i + 1}", i, f"N{i}", i % 2) for i in range(4)], "nation_rownum string, n_nationkey int, n_name string, n_regionkey int")
    region = spark.createDataFrame([("region_1", 0, "R0"), ("region_2", 1, "R1")], "region_rownum string, r_regionkey int, r_name string")
    return Engine(spark, {"nation": nation, "region": region}, log=EventLog(spark, f"file://{tmp_path}/log"))


SQL = "SELECT r.r_name, count(*) AS c FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name"


def test_answer_and_explain(engine):
    reply = engine.chat([{"role": "user", "content": SQL}])
    items = json.loads(reply)
    assert sorted(x["result"]["r_name"] for x in items) == ["R0", "R1"]
    told = engine.explain("How many?", reply)
    assert told["missing_ids"] == [] and told["validation_errors"] == [] and set(told["schema"]) == {"nation", "region"}
    assert sorted(told["formulas"])[0] == "(nation_1 AND region_1) OR (nation_3 AND region_1)"
    assert "nation_1" in told["explanation_text"] and told["rows_by_id"]["nation_1"]["row"]["n_name"] == "N0"
    assert {r.type for r in engine.log.read().collect()} == {"chat", "query", "explain"}


def test_unknown_ids_stop_only_the_explanation(engine):
    told = engine.explain("?", '[{"result":{},"provenance":[["zzz_9"],[]]}]')
    assert told["missing_ids"] == ["zzz_9"] and told["explanation_text"] is None
    assert {f["problem"] for f in told["validation_errors"]} == {"unknown id", "empty", "no explanation: some ids are unknown"}
    assert engine.explain("?", "[]")["formulas"] == []


def test_planner_first(engine):
    got = json.loads(engine.chat([{"role": "user", "content": "SELECT n.n_name FROM nation n WHERE n.n_regionkey = 1"}], route="planner_first"))
    assert got["plan"]["leaf_tasks"][0]["scan_op"] == "FilterLeafScan"
    assert sorted(r["row_id"] for r in got["leaf_outputs"][0]["rows"]) == ["nation_2", "nation_4"]


@pytest.mark.parametrize(("messages", "route"), [([], "sql"), ([{"role": "user", "content": "  "}], "sql"), ([{"role": "user", "content": "x"}], "other"), ([{"role": "user", "content": "x"}], "direct")])
def test_bad_requests(engine, messages, route):
    with pytest.raises(RequestError):
        engine.chat(messages, route=route)


def test_bad_answers(engine):
    with pytest.raises(RequestError):
        engine.explain("?", "{}")


def test_search_finds_rows_by_a_question(engine, tmp_path):
    embed = lambda text: F.array(*[F.size(F.split(F.lower(text), c)).cast("double") for c in "abcdefghijklmnopqrstuvwxyz0123456789"])
    path = f"file://{tmp_path}/vectors"
    got = engine.search("r_regionkey: 1 | r_name: R1", embed, path, max_rows=3)
    assert got[0]["rid"] == "region_2" and got[0]["row"]["r_name"] == "R1" and len(got) == 3
    assert got == engine.search("r_regionkey: 1 | r_name: R1", embed, path, max_rows=3)
    assert len({r["table"] for r in engine.search("nation", embed, path, max_tables=1, max_rows=9)}) == 1
    kinds = [r.type for r in engine.log.read().collect()]
    assert kinds.count("index_built") == 1 and kinds.count("index_loaded") >= 2


def test_models_and_debug(engine):
    assert {m["id"] for m in engine.models()} == {"planner_first", "sql"}
    assert engine.debug()["sql"] is None
    engine.query("SELECT n_name FROM nation WHERE n_name < 'z'").collect()
    view = engine.debug()
    assert view["plan"]["leaf_tasks"][0]["local_predicates"] == ["n_name < 'z'"] and "Physical Plan" in view["physical"]
    page = engine.debug(as_html=True)
    assert "n_name &lt; &#x27;z&#x27;" in page and "<script" not in page


def test_planner_failures_are_request_errors(engine):
    for sql in ("INSERT INTO nation SELECT * FROM nation", "SELECT 1 +"):
        with pytest.raises(RequestError):
            engine.chat([{"role": "user", "content": sql}], route="planner_first")
    got = json.loads(engine.chat([{"role": "user", "content": "WITH x AS (SELECT r_regionkey FROM region WHERE r_regionkey = 1) SELECT n_name FROM NATION JOIN x ON n_regionkey = r_regionkey"}], route="planner_first"))
    assert [[r["row_id"] for r in x["rows"]] for x in got["leaf_outputs"]] == [["nation_1", "nation_2", "nation_3", "nation_4"], ["region_2"]]
