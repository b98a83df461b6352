"""Leaf scans: one table's rows with its own filters and the columns a query needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalog import CATALOG
from ..sources.tables import RID, id_parts, tagged


def leaf_scan(spark: SparkSession, table: str, columns: list[str] | None = None, predicates: list[str] = ()) -> DataFrame:
    """(__rid, columns): LeafScan without predicates, FilterLeafScan with; filters and columns reach the file scan."""
    df = spark.table(table)
    for p in predicates:
        df = df.where(p)
    return tagged(df, table if table in CATALOG else table.lower()).select(RID, *(columns or [c for c in df.columns if c != RID]))


def leaf_json(leaf: DataFrame) -> DataFrame:
    """(leaf): each row as {"row_id", "values"} JSON."""
    values = F.struct(*[F.col(c) for c in leaf.columns if c != RID])
    return leaf.select(F.to_json(F.struct(F.col(RID).alias("row_id"), values.alias("values")), {"ignoreNullFields": "false"}).alias("leaf"))


def leaf_page(leaf: DataFrame, size: int, after: str | None = None) -> DataFrame:
    """The next rows by row id after the last one seen; a page costs one pass with a bounded top-k."""
    return (leaf if after is None else leaf.where(F.col(RID) > after)).orderBy(RID).limit(size)


def leaf_page_by_key(spark: SparkSession, table: str, columns: list[str], predicates: list[str], size: int, after: str | None = None) -> DataFrame:
    """The next rows after an id in the order of the table's keys as numbers; ``after`` may name the first keys only.

    The first key's bound is a filter on the table's own column, so that the scan
    skips files and row groups that were seen; later keys decide among its equals.
    Tables whose ids are texts of their own are paged by these.
    """
    df = spark.table(table)
    for p in predicates:
        df = df.where(p)
    parts = id_parts(table, df.columns)
    if parts is None:
        return leaf_page(leaf_scan(spark, table, columns, predicates), size, after)
    if after is not None:
        seen = [int(x) for x in after.removeprefix(f"{table}_").split("_")]
        single, key = len(CATALOG[table].primary_key) == 1, CATALOG[table].primary_key[0]
        df = df.where(F.col(key) >= F.lit(seen[0] - single).cast(df.schema[key].dataType))
        df = df.where(F.struct(*parts[: len(seen)]) > F.struct(*[F.lit(x).cast("long") for x in seen]))
    page = tagged(df, table).orderBy(*parts).limit(size)
    return page.select(RID, *columns)


def unseen(leaf: DataFrame, seen: DataFrame) -> DataFrame:
    """The rows whose ids haven't been given yet."""
    return leaf.join(seen.select(RID), RID, "left_anti")


def run_leaves(spark: SparkSession, descriptor: dict) -> list[tuple[dict, DataFrame]]:
    """Every leaf task of a descriptor with its scan."""
    clean = lambda t: [c for c in t["columns"] if c != "*"] if "*" not in t["columns"] else None
    return [(t, leaf_scan(spark, t["table_name"], clean(t) or None, t["local_predicates"])) for t in descriptor["leaf_tasks"]]
