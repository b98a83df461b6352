"""Reading tables from Parquet and from delimited text, with row ids."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import CATALOG, CONTENT_KEYS, HUNDREDTHS, row_id

RID = "__rid"


def read_parquet_tables(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names or ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]}


def register(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def tagged(df: DataFrame, table: str) -> DataFrame:
    """The table with its row ids; rows without one are left out."""
    return df.withColumn(RID, row_id(table, df.columns)).where(F.col(RID) != "")


def read_delimited(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A ``|``-delimited file with a header and a ``<table>_rownum`` column, all values text.

    Doubled quotes and line breaks in quotes are kept, surplus fields dropped,
    missing ones null; empty fields are null. Rows with a blank id are left out
    and ids lose outer blanks; values keep their padding.
    """
    df = spark.read.csv(path, sep="|", header=True, inferSchema=False, escape='"', multiLine=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    if f"{table}_rownum" not in df.columns:
        raise ValueError(f"{path}: no column {table}_rownum")
    return tagged(df, table)


def read_delimited_folder(spark: SparkSession, folder: str, log=None) -> dict[str, DataFrame]:
    """Every ``.csv`` file of a folder by its stem; without the folder no tables, and an entry in the log."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(where):
        if log is not None:
            log.write({"type": "tables_missing", "folder": folder})
        return {}
    files = sorted(f.getPath().toString() for f in store.listStatus(where) if f.getPath().getName().endswith(".csv"))
    return {(stem := f.rsplit("/", 1)[1].removesuffix(".csv")): read_delimited(spark, f, stem) for f in files}


def rid_index(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rid, row): every row of every table by its id; row maps columns to texts."""
    out = None
    for name, df in sorted(tables.items()):
        columns = [c for c in df.columns if c != RID]
        entries = F.map_from_entries(F.array(*[F.struct(F.lit(c), F.col(c).cast("string")) for c in columns]))
        part = tagged(df, name).select(F.lit(name).alias("table_name"), F.col(RID).alias("rid"), entries.alias("row"))
        out = part if out is None else out.unionByName(part)
    return out


def id_parts(table: str, columns: list[str]) -> list[Column] | None:
    """The whole numbers that a table's row ids are made of, in order; None where ids are texts of their own."""
    known = CATALOG.get(table)
    if f"{table}_rownum" in columns or known is None:
        return None
    if len(known.primary_key) == 1:
        key = known.primary_key[0]
        return [F.col(key).cast("long") + 1] if key in columns else None
    keys = [c for c in CONTENT_KEYS.get(table, known.primary_key) if c in columns]
    return [F.round(F.col(c) * 100).cast("long") if c in HUNDREDTHS else F.col(c).cast("long") for c in keys] or None


def _keyed(df: DataFrame, table: str) -> DataFrame:
    """The table with its id as numbers: __key, the first, and __rest; rows without an id are left out."""
    parts = F.array_compact(F.array(*id_parts(table, df.columns)))
    return df.withColumn("__parts", parts).where(F.size("__parts") > 0).withColumn("__key", F.get("__parts", 0)).withColumn("__rest", F.slice("__parts", 2, 64)).drop("__parts")


def typed_ids(rids: DataFrame) -> DataFrame:
    """(rid, table_name, __key, __rest): ids taken apart; keys are null where a text isn't written as ids are."""
    numbers = F.transform(F.slice(F.split("rid", "_"), 2, 64), lambda x: x.try_cast("long"))
    out = rids.select("rid", F.element_at(F.split("rid", "_"), 1).alias("table_name"), numbers.alias("n"))
    written = F.concat_ws("_", "table_name", F.transform("n", lambda x: x.cast("string")))
    own = (written == F.col("rid")) & F.forall("n", lambda x: x.isNotNull()) & (F.size("n") > 0)
    return out.select("rid", "table_name", F.when(own, F.get("n", 0)).alias("__key"), F.when(own, F.slice("n", 2, 64)).alias("__rest"))


def known_ids(rids: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(rid): those of the ids that some row has, each once.

    The tables give their keys as numbers, and the ids are taken apart; only
    tables whose ids are texts of their own are compared by text. The tables are
    the left of a semi join, so that few ids are broadcast and no table moves.
    """
    ids, found = rids.select("rid").distinct(), []
    named = {n: df for n, df in tables.items() if id_parts(n, df.columns) is not None}
    if named:
        asked, keys = typed_ids(ids).where("__key IS NOT NULL"), None
        for name, df in sorted(named.items()):
            part = _keyed(df, name).select(F.lit(name).alias("table_name"), "__key", "__rest")
            keys = part if keys is None else keys.unionByName(part)
        on = ["table_name", "__key", "__rest"]
        found.append(asked.join(keys.join(asked.select(*on), on, "left_semi"), on, "left_semi").select("rid"))
    texts = {n: df for n, df in tables.items() if n not in named}
    if texts:
        found.append(rid_index(texts).select("rid").join(ids, "rid", "left_semi"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.distinct()


def find_rows(rids: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rid, row) of the ids that some row has; rows are told only where their keys are asked for."""
    ids, out = rids.select("rid").distinct(), None
    asked = typed_ids(ids).where("__key IS NOT NULL")
    for name, df in sorted(tables.items()):
        if id_parts(name, df.columns) is None:
            part = rid_index({name: df}).join(ids, "rid", "left_semi")
        else:
            columns = [c for c in df.columns if c != RID]
            own = asked.where(F.col("table_name") == name).drop("table_name")
            entries = F.map_from_entries(F.array(*[F.struct(F.lit(c), F.col(c).cast("string")) for c in columns]))
            part = _keyed(df, name).join(own, ["__key", "__rest"]).select(F.lit(name).alias("table_name"), "rid", entries.alias("row"))
        out = part.select("table_name", "rid", "row") if out is None else out.unionByName(part.select("table_name", "rid", "row"))
    return out


def resolve(rids: DataFrame, index: DataFrame | dict[str, DataFrame]) -> DataFrame:
    """(rid, table_name, row): unknown ids have a null table and row.

    ``index`` is the tables by name, whose keys are compared as numbers, or a
    ready index. It is joined inner, so that AQE can broadcast the ids where they
    are few and no table is shuffled; what was found is then as small as the ids.
    """
    found = find_rows(rids, index) if isinstance(index, dict) else index.join(rids.select("rid").distinct(), "rid")
    return rids.join(found, "rid", "left")


def key_filter(table: str, columns: list[str], rids: list[str]) -> Column | None:
    """A filter on the table's own columns that keeps at least the rows with these ids, or None if no row can have them."""
    if f"{table}_rownum" in columns:
        return F.trim(F.col(f"{table}_rownum")).isin(rids)
    parts = [r.removeprefix(f"{table}_").split("_") for r in rids if r.startswith(f"{table}_")]
    key = CATALOG[table].primary_key[0] if table in CATALOG else None
    if key is None or key not in columns:
        return F.lit(True) if parts else None
    first = 1 if len(CATALOG[table].primary_key) == 1 else 0
    whole = [int(p[0]) - first for p in parts if p[0].removeprefix("-").isdigit() and len(p[0]) <= 18]
    return F.col(key).isin(sorted(set(whole))) if whole else None


def look_up(tables: dict[str, DataFrame], rids: list[str]) -> DataFrame | None:
    """(table_name, rid, row) of a stated list of ids; key values are pushed into each table's scan.

    Tables that can't hold any of the ids aren't read; None if no table can.
    """
    some = {}
    for name, df in tables.items():
        if (keep := key_filter(name, df.columns, rids)) is not None:
            some[name] = df.where(keep)
    return rid_index(some).where(F.col("rid").isin(rids)) if some else None


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, a local one, if Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='whyframe-')}"
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def known_tables() -> list[str]:
    return list(CATALOG)
