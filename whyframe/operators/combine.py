"""Running a plan descriptor: leaf outputs joined, then the post-operations in order, with provenance from the leaves' row ids.

The descriptor alone is read, not the query it came from. Leaf scans give the
rows; joins and post-operations are put together again as one query over them,
which Catalyst plans like any other. Tables inside subqueries, derived tables
and common table expressions are read by name, as their texts say.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalog import row_id
from ..sources.tables import RID
from .leaves import run_leaves
from .provenance import MODES, Rewriter, base_tables

_USING = re.compile(r"UsingJoin\(\w+, ?(?:List\(|\[)(.*?)[)\]]")


class DescriptorError(ValueError):
    """A descriptor that doesn't hold all that its query does."""


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _named(descriptor: dict, views: dict[int, str], source: dict, lateral: bool = False) -> str:
    """What a FROM item reads: a leaf's view, a common table expression, or a table that the query makes."""
    alias = source.get("alias") or source.get("table")
    if alias is None:
        raise DescriptorError("a join of joins has no name to read")
    if source.get("table") is not None:
        for i, task in enumerate(descriptor["leaf_tasks"]):
            if task.get("scope") is None and (task["table_name"], task["alias"]) == (source["table"], source.get("alias")):
                return f"{views[i]} AS {_quoted(alias)}"
        if source["table"] in descriptor.get("ctes", []):
            return f"{_quoted(source['table'])} AS {_quoted(alias)}"
        raise DescriptorError(f"no leaf reads {source['table']}")
    for made in descriptor.get("derived", []):
        if made["alias"] == alias and made["kind"] == ("lateral" if lateral else "derived"):
            return f"{'LATERAL ' if lateral else ''}({made['sql']}) AS {_quoted(alias)}"
    raise DescriptorError(f"{alias} isn't told")


def _joined(descriptor: dict, views: dict[int, str]) -> str:
    text = _named(descriptor, views, descriptor["from"])
    for join in descriptor["joins"]:
        kind, using = join["join_type"], join.get("using", "")
        lateral = kind.endswith(" LATERAL")
        kind = kind.removesuffix(" LATERAL")
        if using.startswith("NaturalJoin"):
            kind = f"NATURAL {kind}"
        elif join["on_sql"] is None and not using and kind == "INNER":
            kind = "CROSS"
        text += f" {kind} JOIN {_named(descriptor, views, join, lateral)}"
        if using.startswith("UsingJoin"):
            text += f" USING ({', '.join(_quoted(c.strip()) for c in _USING.match(using)[1].split(','))})"
        elif join["on_sql"] is not None:
            text += f" ON {join['on_sql']}"
    return text


def query_of(descriptor: dict, views: dict[int, str]) -> str:
    """The descriptor's joins and post-operations as one query over views of the leaves."""
    if descriptor.get("untold"):
        raise DescriptorError(f"not told in a descriptor: {', '.join(descriptor['untold'])}")
    if not descriptor.get("from") and descriptor["leaf_tasks"]:
        raise DescriptorError("only full descriptors can be run")
    ops = {p["op"]: p["payload"] for p in descriptor["post_ops"]}
    items = []
    for item in ops["Project"]["select"]:
        ends = item["alias"] and re.search(rf"(?i)\s`?{re.escape(item['alias'])}`?$", item["sql"])
        items.append(item["sql"] if not item["alias"] or ends else f"{item['sql']} AS {_quoted(item['alias'])}")
    made = ", ".join(f"{_quoted(x['alias'])} AS ({x['sql']})" for x in descriptor.get("derived", []) if x["kind"] == "cte")
    text = f"{f'WITH {made} ' if made else ''}SELECT {'DISTINCT ' if 'Distinct' in ops else ''}{', '.join(items)}"
    if descriptor.get("from"):
        text += f" FROM {_joined(descriptor, views)}"
    if "Filter" in ops:
        text += " WHERE " + " AND ".join(f"({p})" for p in ops["Filter"]["predicates"])
    if "GroupBy" in ops:
        keys = [re.sub(r"(?is)^group\s+by\s+", "", k) for k in ops["GroupBy"]["keys"]]
        text += " GROUP BY " + ", ".join(keys)
    if "Having" in ops:
        text += f" HAVING {ops['Having']['predicate']}"
    if "OrderBy" in ops:
        text += " ORDER BY " + ", ".join(x["sql"] for x in ops["OrderBy"]["items"])
    if "Limit" in ops:
        text += f" LIMIT {ops['Limit']['value']}"
    if "Offset" in ops:
        text += f" OFFSET {ops['Offset']['value']}"
    return text


def run_descriptor(spark: SparkSession, descriptor: dict, prov: str = "full", tables: set[str] | None = None) -> DataFrame:
    """The result of a full descriptor, with provenance as ``sql_with_why`` gives it; DescriptorError if it doesn't tell the whole query."""
    if prov not in MODES:
        raise ValueError(f"prov must be one of {MODES}")
    run, views = uuid.uuid4().hex[:12], {}
    query = query_of(descriptor, {i: f"__leaf_{run}_{i}" for i in range(len(descriptor["leaf_tasks"]))})
    for i, (task, df) in enumerate(run_leaves(spark, descriptor)):
        if task.get("scope") is None:
            views[i] = f"__leaf_{run}_{i}"
            df.withColumnRenamed(RID, f"{RID}_{i}").createOrReplaceTempView(views[i])
    known = {x.lower() for x in (base_tables(spark) if tables is None else tables)}

    def rid(table: str, columns: list[str]):
        own = [c for c in columns if c.startswith(f"{RID}_")]
        return F.col(own[0]) if own else row_id(table, columns)

    try:
        out = spark.sql(query) if prov == "off" else Rewriter(spark, rid, hashed=prov == "digest").run(query, known | set(views.values()), prov)
        return out.drop(*[c for c in out.columns if c.startswith(f"{RID}_")])
    finally:
        for name in views.values():
            spark.catalog.dropTempView(name)
