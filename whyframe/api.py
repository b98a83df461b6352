"""The engine's front: plan, run, answer, check and explain queries."""

from __future__ import annotations

import html
import json
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import why
from .operators import answers, leaves, models, retrieval
from .operators.combine import run_descriptor
from .operators.provenance import WHY, sql_with_why
from .plans.descriptor import describe
from .sources import catalog, tables
from .sources.eventlog import EventLog

# The ways to answer that a request may name.
ROUTES = ("direct", "planner_first", "sql")


class RequestError(ValueError):
    """The request can't be served; nothing was run."""


class Engine:
    """Queries over a set of tables, each a DataFrame with or without a ``<table>_rownum`` column."""

    def __init__(self, spark: SparkSession, data: dict[str, DataFrame], log: EventLog | None = None, client: models.ModelClient | None = None):
        self.spark, self.data, self.log, self.client = spark, {n.lower(): df for n, df in data.items()}, log, client
        self.last: dict = {}
        tables.register(spark, data)

    @classmethod
    def from_delimited(cls, spark: SparkSession, folder: str, **options) -> Engine:
        return cls(spark, tables.read_delimited_folder(spark, folder, options.get("log")), **options)

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str, names: list[str] | None = None, **options) -> Engine:
        return cls(spark, tables.read_parquet_tables(spark, folder, names), **options)

    def _note(self, kind: str, **fields) -> None:
        if self.log is not None:
            self.log.write({"type": kind, **fields})

    def plan(self, sql: str, compat: bool = False) -> dict:
        return describe(self.spark, sql, compat)

    def query(self, sql: str, prov: str = "full") -> DataFrame:
        """The query's rows with column ``why``."""
        self._note("query", sql=sql, prov=prov)
        self.last = {"sql": sql, "prov": prov}
        return sql_with_why(self.spark, sql, prov, set(self.data))

    def answer(self, sql: str) -> DataFrame:
        """(answer): the rows as JSON objects with result and provenance."""
        return answers.answer_rows(self.query(sql), WHY)

    def planner_first(self, sql: str, compat: bool = False) -> dict:
        """The descriptor and the scan of every leaf as DataFrames of JSON rows."""
        plan = self.plan(sql, compat)
        return {"sql": sql, "plan": plan, "leaf_outputs": [{"task": t, "rows": leaves.leaf_json(df)} for t, df in leaves.run_leaves(self.spark, plan)]}

    def combine(self, plan: dict, prov: str = "full") -> DataFrame:
        """Run a full descriptor: its leaf outputs joined and its post-operations applied, with provenance."""
        return run_descriptor(self.spark, plan, prov, set(self.data))

    def index(self) -> DataFrame:
        return tables.rid_index(self.data)

    def resolve(self, rids: list[str]) -> dict[str, dict | None]:
        """A stated list of ids: {table, rid, row} of each, None for unknown ones."""
        rids = [r for r in dict.fromkeys(rids) if r]
        found: dict[str, dict] = {}
        for k in range(0, len(rids), 1000):
            some = tables.look_up(self.data, rids[k : k + 1000])
            found |= {r.rid: {"table": r.table_name, "rid": r.rid, "row": r.row} for r in (some.collect() if some is not None else [])}
        return {r: found.get(r) for r in rids}

    def explain(self, question: str, answer_text: str) -> dict:
        """Check, resolve and explain one answer text. Faults of the provenance are listed and don't stop it."""
        try:
            items = answers.parse_answer(answer_text)
        except answers.AnswerError as e:
            raise RequestError(str(e)) from e
        frame = self.spark.createDataFrame([(i, json.dumps(x["result"], ensure_ascii=False), x["provenance"]) for i, x in enumerate(items)], "id int, result string, provenance array<array<string>>")
        ids = sorted({r for x in items for w in x["provenance"] for r in w})
        rows = self.resolve(ids)
        missing = [r for r in ids if rows.get(r) is None]
        faults = [{"item": r.id, "set": r.set_no, "problem": r.problem, "rid": r.rid} for r in answers.validate(frame, self.data).orderBy("id", "set_no", "problem", "rid").collect()]
        text = None
        if missing:
            faults.append({"item": None, "set": None, "problem": "no explanation: some ids are unknown", "rid": None})
        else:
            text = "\n\n".join(r.explanation for r in answers.explain_rows(frame, question, self.data).orderBy("id").collect())
        formulas = [r.formula for r in frame.orderBy("id").select(why.formula(F.col("provenance")).alias("formula")).collect()]
        used = sorted({r["table"] for r in rows.values() if r})
        self._note("explain", question=question, missing=len(missing), faults=len(faults))
        return {"question": question, "answer": items, "formulas": formulas, "rows_by_id": {k: v for k, v in rows.items() if v}, "missing_ids": missing, "validation_errors": faults, "schema": catalog.schema_subset(used), "explanation_text": text}

    def chat(self, messages: list[dict], route: str = "sql", temperature: float = 0.0, context: list[dict] = ()) -> str:
        """The reply to the last user message: SQL is run, other questions go to the model that was handed in."""
        question = next((str(m.get("content", "")).strip() for m in reversed(messages) if m.get("role") == "user"), "")
        if not question:
            raise RequestError("no question")
        if route not in ROUTES:
            raise RequestError(f"route must be one of {ROUTES}")
        self._note("chat", question=question, route=route)
        if route == "sql":
            return "[" + ",".join(r.answer for r in self.answer(question).toLocalIterator()) + "]"
        if route == "planner_first":
            try:
                done = self.planner_first(question)
            except (ValueError, PySparkException) as e:
                raise RequestError(f"no plan: {str(e).splitlines()[0]}") from e
            return json.dumps({**done, "leaf_outputs": [{"task": x["task"], "rows": [json.loads(r.leaf) for r in x["rows"].toLocalIterator()]} for x in done["leaf_outputs"]]}, ensure_ascii=False)
        if self.client is None:
            raise RequestError("no model was handed in")
        return models.ask_for_array(self.client, models.answer_prompt(question, list(context)), models.ANSWER_TRIES, temperature, self._note)

    def retrieve(self, hits: DataFrame, max_rows: int = retrieval.MAX_ROWS, max_tables: int = retrieval.MAX_TABLES) -> DataFrame:
        return retrieval.capped(hits, self.index(), max_rows, max_tables)

    def search(self, question: str, embed: Callable[[Column], Column], path: str, allow: list[str] | None = None, k: int = retrieval.TOP_K, max_rows: int = retrieval.MAX_ROWS, max_tables: int = retrieval.MAX_TABLES) -> list[dict]:
        """The rows nearest to a question, best first: {table, rid, row}; the index is loaded from ``path`` or built there.

        ``embed`` maps a text column to a column of vectors, for the rows and
        for the question alike.
        """
        saved = retrieval.load_or_build(self.spark, path, lambda: retrieval.index_documents(self.data, allow, embed), self._note)
        vector = self.spark.range(1).select(embed(F.lit(question)).alias("v")).first().v
        nearest = retrieval.vector_top_k(saved, F.lit([float(x) for x in vector]), k, id_col="rid").collect()
        if not nearest:
            return []
        hits = self.spark.createDataFrame([(i, r.rid) for i, r in enumerate(nearest)], "rank int, rid string")
        known = tables.look_up(self.data, [r.rid for r in nearest])
        if known is None:
            return []
        best = retrieval.capped(hits, known, max_rows, max_tables).orderBy("rank").collect()
        rows = self.resolve([r.rid for r in best])
        self._note("retrieval", question=question, rows=[r.rid for r in best])
        return [rows[r.rid] for r in best]

    def models(self) -> list[dict]:
        """What ``chat`` can be asked for: the routes, in the form of a model list."""
        return [{"id": route, "object": "model"} for route in ROUTES if route != "direct" or self.client is not None]

    def debug(self, as_html: bool = False) -> dict | str:
        """The last query with its descriptor and its formatted physical plan, as a dict or as a page."""
        if not self.last:
            view = {"sql": None, "plan": None, "physical": None}
        else:
            sql, prov = self.last["sql"], self.last["prov"]
            df = sql_with_why(self.spark, sql, prov, set(self.data))
            try:
                plan = self.plan(sql)
            except ValueError as e:
                plan = {"error": str(e)}
            view = {"sql": sql, "plan": plan, "physical": self.spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")}
        if not as_html:
            return view
        part = lambda name, value: f"<h2>{name}</h2><pre>{html.escape(value if isinstance(value, str) else json.dumps(value, indent=1, ensure_ascii=False))}</pre>"
        return "<!doctype html><title>last query</title>" + "".join(part(n, v) for n, v in view.items())
