"""Answers with provenance: JSON out and in, checks, resolution and explanation.

An answer is a JSON array of objects with exactly the keys ``result`` (an
object) and ``provenance`` (a list of lists of row-id strings).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import why
from ..sources.tables import known_ids, resolve

KEYS = {"result", "provenance"}


class AnswerError(ValueError):
    """The text isn't an answer; the message names the item by its index."""


def answer_rows(df: DataFrame, prov: str = "why") -> DataFrame:
    """(answer): a JSON object with result and provenance for each row; nulls are written out."""
    result = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != prov])
    return df.select(F.to_json(F.struct(result.alias("result"), F.col(prov).alias("provenance")), {"ignoreNullFields": "false"}).alias("answer"))


def is_json_array(text: Column) -> Column:
    """Whether a text is a JSON array; false for null and for text that isn't JSON."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(text)).like("ARRAY<%"), F.lit(False))


def parse_answer(text: str) -> list[dict]:
    """One answer text, checked; for a column of texts see ``check_answers``."""
    try:
        data = json.loads(text)
    except (TypeError, ValueError) as e:
        raise AnswerError(f"invalid JSON: {e}") from e
    if not isinstance(data, list):
        raise AnswerError("the answer must be a JSON array")
    for i, item in enumerate(data):
        if problem := _item_problem(item):
            raise AnswerError(f"item {i}: {problem}")
    return data


def _item_problem(item) -> str | None:
    if not isinstance(item, dict):
        return "must be an object"
    if set(item) != KEYS:
        return "must have exactly the keys result and provenance"
    if not isinstance(item["result"], dict):
        return "result must be an object"
    sets = item["provenance"]
    if not isinstance(sets, list) or not all(isinstance(w, list) for w in sets):
        return "provenance must be a list of lists"
    if not all(isinstance(x, str) for w in sets for x in w):
        return "row ids must be strings"
    return None


def check_answers(texts: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """(key, problem, item): the first problem of each answer text, null if there is none.

    Goes by the shape of the parsed variant, as a parse with a fixed schema
    would accept lone objects and turn numbers into strings.
    """
    v = F.try_parse_json(F.col(text))
    root = texts.select(key, v.alias("v"), F.schema_of_variant(v).alias("shape"))
    bad = root.select(key, F.when(F.col("v").isNull(), "invalid JSON").when(~F.col("shape").like("ARRAY<%"), "root not an array").alias("problem"), F.lit(-1).alias("item"))
    items = root.where("shape LIKE 'ARRAY<%'").select(key, F.posexplode_outer(F.expr("cast(v as array<variant>)")).alias("item", "x"))
    shape = lambda c: F.schema_of_variant(c)
    keys = F.array_sort(F.json_object_keys(F.to_json("x")))
    prov = F.expr("try_variant_get(x, '$.provenance', 'variant')")
    problem = (
        F.when(~shape(F.col("x")).like("OBJECT<%"), "item not an object")
        .when(keys != F.array(F.lit("provenance"), F.lit("result")), "wrong keys")
        .when(~shape(F.expr("try_variant_get(x, '$.result', 'variant')")).like("OBJECT<%"), "result not an object")
        .when(~shape(prov).like("ARRAY<%"), "provenance not a list")
        .when(~shape(prov).isin("ARRAY<VOID>", "ARRAY<ARRAY<VOID>>", "ARRAY<ARRAY<STRING>>"), F.when(shape(prov).like("ARRAY<ARRAY<%"), "id not a string").otherwise("provenance not a list"))
    )
    found = items.where("x IS NOT NULL").select(key, problem.alias("problem"), "item").unionByName(bad).where("problem IS NOT NULL")
    first = found.groupBy(key).agg(F.min(F.struct("item", "problem")).alias("first"))
    return texts.select(key).join(first, key, "left").select(key, F.col("first.problem").alias("problem"), F.col("first.item").cast("long").alias("item"))


def witnesses(answers: DataFrame, key: str = "id", prov: str = "provenance") -> DataFrame:
    """(key, set_no, witness) of every witness set; numbers count from 0."""
    return answers.select(key, F.posexplode(prov).alias("set_no", "witness"))


def validate(answers: DataFrame, index: DataFrame | dict[str, DataFrame], key: str = "id", prov: str = "provenance") -> DataFrame:
    """(key, set_no, problem, rid): every fault of the provenance; none of them stops the others.

    Empty sets, ids repeated in a set, unknown ids (each place once) and sets
    that repeat an earlier one in any order. ``index`` is the tables by name, or
    has the known ids in column rid. Repeats within an answer are told by its own array, sorted, so no
    key's sets are shuffled together and no set is compared with all others.
    """
    sets = witnesses(answers, key, prov)
    empty = sets.where(F.size("witness") == 0).select(key, "set_no", F.lit("empty").alias("problem"), F.lit(None).cast("string").alias("rid"))
    twice = sets.where(F.size("witness") != F.size(F.array_distinct("witness"))).select(key, "set_no", F.lit("repeated id").alias("problem"), F.lit(None).cast("string").alias("rid"))
    ids = sets.select(key, "set_no", F.explode("witness").alias("rid"))
    unknown = ids.join(missing_ids(answers, index, prov), "rid", "left_semi").select(key, "set_no", F.lit("unknown id").alias("problem"), "rid")
    # equal sets stand together after a sort, first the one that came first; the sorted array is bound once, so the filter is one pass
    ordered = F.sort_array(F.transform(prov, lambda w, i: F.struct(F.sort_array(w).alias("w"), i.alias("set_no"))))
    later = F.transform(F.array(ordered), lambda s: F.filter(s, lambda x, i: (i > 0) & x["w"].eqNullSafe(F.get(s, i - 1)["w"])))[0]
    again = answers.select(key, F.explode(F.transform(later, lambda x: x["set_no"])).alias("set_no"))
    repeated = again.select(key, "set_no", F.lit("repeated set").alias("problem"), F.lit(None).cast("string").alias("rid"))
    return empty.unionByName(twice).unionByName(unknown).unionByName(repeated)


def missing_ids(answers: DataFrame, index: DataFrame | dict[str, DataFrame], prov: str = "provenance") -> DataFrame:
    """(rid): the ids that no table has, each once; ``index`` is the tables by name or a ready index.

    Tables give their keys as numbers. An index is cut to the asked ids first, a
    join whose right side, the ids, AQE can broadcast; so the tables aren't
    shuffled for a few answers.
    """
    ids = answers.select(F.explode(F.flatten(prov)).alias("rid")).distinct()
    known = known_ids(ids, index) if isinstance(index, dict) else index.select("rid").join(ids, "rid", "left_semi")
    return ids.join(known, "rid", "left_anti")


def formulas(answers: DataFrame, key: str = "id", prov: str = "provenance") -> DataFrame:
    return answers.select(key, why.formula(F.col(prov)).alias("formula"))


def explain_rows(answers: DataFrame, question: str, index: DataFrame | dict[str, DataFrame], key: str = "id", prov: str = "provenance") -> DataFrame:
    """(key, explanation): what was asked, the result, and the rows that each derivation rests on.

    answers: key, result (JSON text), provenance. The text is a template over
    the resolved rows, so it is the same every time.
    """
    ids = witnesses(answers, key, prov).select(key, "set_no", F.posexplode("witness").alias("place", "rid"))
    told = resolve(ids, index)
    values = F.array_join(F.transform(F.array_sort(F.map_entries(F.map_filter("row", lambda k, v: v.isNotNull() & ~k.endswith("_rownum")))), lambda e: F.concat(e["key"], F.lit(" "), F.trim(e["value"]))), ", ")
    told = told.withColumn("text", F.when(F.col("table_name").isNull(), F.concat("rid", F.lit(" (unknown)"))).otherwise(F.concat("rid", F.lit(" ("), values, F.lit(")"))))
    sets = told.groupBy(key, "set_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), " together with ").alias("line"))
    lines = sets.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("set_no", "line"))), lambda x: F.concat(F.lit("- "), x["line"])), "\n").alias("lines"))
    out = answers.select(key, "result", F.size(prov).alias("n")).join(lines, key, "left")
    text = F.concat(F.lit(f"Question: {question}\nResult: "), "result", F.lit("\nProvenance, "), F.col("n").cast("string"), F.lit(" derivation(s):\n"), F.coalesce("lines", F.lit("- none")))
    return out.select(key, text.alias("explanation"))
