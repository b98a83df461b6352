"""Schema catalog: columns, keys and row ids of the tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[str, ...]
    primary_key: tuple[str, ...]
    foreign_keys: dict[str, str] = field(default_factory=dict)

    @property
    def row_id(self) -> str:
        return f"{self.name}_rownum"


# Names and keys of the eight tables, as the public TPC-H schema has them.
CATALOG: dict[str, Table] = {
    t.name: t
    for t in (
        Table("region", ("r_regionkey", "r_name", "r_comment"), ("r_regionkey",)),
        Table("nation", ("n_nationkey", "n_name", "n_regionkey", "n_comment"), ("n_nationkey",), {"n_regionkey": "region.r_regionkey"}),
        Table("customer", ("c_custkey", "c_name", "c_address", "c_nationkey", "c_phone", "c_acctbal", "c_mktsegment", "c_comment"), ("c_custkey",), {"c_nationkey": "nation.n_nationkey"}),
        Table("orders", ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "o_clerk", "o_shippriority", "o_comment"), ("o_orderkey",), {"o_custkey": "customer.c_custkey"}),
        Table(
            "lineitem",
            ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", "l_commitdate", "l_receiptdate", "l_shipinstruct", "l_shipmode", "l_comment"),
            ("l_orderkey", "l_linenumber"),
            {"l_orderkey": "orders.o_orderkey", "l_partkey": "part.p_partkey", "l_suppkey": "supplier.s_suppkey"},
        ),
        Table("supplier", ("s_suppkey", "s_name", "s_address", "s_nationkey", "s_phone", "s_acctbal", "s_comment"), ("s_suppkey",), {"s_nationkey": "nation.n_nationkey"}),
        Table("part", ("p_partkey", "p_name", "p_mfgr", "p_brand", "p_type", "p_size", "p_container", "p_retailprice", "p_comment"), ("p_partkey",)),
        Table("partsupp", ("ps_partkey", "ps_suppkey", "ps_availqty", "ps_supplycost", "ps_comment"), ("ps_partkey", "ps_suppkey"), {"ps_partkey": "part.p_partkey", "ps_suppkey": "supplier.s_suppkey"}),
    )
}

#: Columns that tell rows apart where the primary key doesn't: the generated line items repeat it.
CONTENT_KEYS = {"lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")}

#: Columns of these that are amounts, which count in hundredths.
HUNDREDTHS = {"l_quantity", "l_extendedprice"}


def row_id(table: str, columns: list[str]) -> Column:
    """The row id of a table's rows, made from the row alone, so that ids need no numbering pass.

    A ``<table>_rownum`` column is used as it is. Else a single integer key k
    gives ``<table>_<k + 1>``, and other keys are joined; amounts count in
    hundredths.
    """
    if f"{table}_rownum" in columns:
        return F.trim(F.col(f"{table}_rownum"))
    known = CATALOG.get(table)
    if known and len(known.primary_key) == 1 and known.primary_key[0] in columns:
        return F.concat(F.lit(f"{table}_"), (F.col(known.primary_key[0]).cast("long") + 1).cast("string"))
    if known:
        keys = [c for c in CONTENT_KEYS.get(table, known.primary_key) if c in columns]
        return F.concat_ws("_", F.lit(table), *[(F.round(F.col(c) * 100).cast("long") if c in HUNDREDTHS else F.col(c)).cast("string") for c in keys])
    return F.concat_ws("_", F.lit(table), F.xxhash64(*[F.col(c) for c in columns]).cast("string"))


def catalog_frame(spark: SparkSession) -> DataFrame:
    """(table_name, position, column_name, is_key, refers_to), one row for each column."""
    rows = [(t.name, i, c, c in t.primary_key, t.foreign_keys.get(c)) for t in CATALOG.values() for i, c in enumerate(t.columns)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, is_key boolean, refers_to string")


# The words by which a question names a table.
ALIASES: dict[str, list[str]] = {
    "region": ["region", "regions"],
    "nation": ["nation", "nations"],
    "customer": ["customer", "customers"],
    "orders": ["order", "orders"],
    "lineitem": ["lineitem", "line item", "line items"],
    "supplier": ["supplier", "suppliers"],
    "part": ["part", "parts"],
    "partsupp": ["partsupp", "part supplier", "part suppliers"],
}


def aliases_frame(spark: SparkSession) -> DataFrame:
    """(table_name, alias): the words by which a question may name a table."""
    return spark.createDataFrame([(t, a) for t, words in ALIASES.items() for a in words], "table_name string, alias string")


def references_frame(spark: SparkSession) -> DataFrame:
    """(table_name, other): the tables that a table's foreign keys refer to."""
    pairs = {(t.name, ref.split(".")[0]) for t in CATALOG.values() for ref in t.foreign_keys.values()}
    return spark.createDataFrame(sorted(pairs), "table_name string, other string")


def schema_subset(tables: list[str]) -> dict[str, dict]:
    """The catalog's entries of some tables, in order."""
    return {n: {"columns": list(CATALOG[n].columns), "primary_key": list(CATALOG[n].primary_key), "row_id": CATALOG[n].row_id, "foreign_keys": dict(CATALOG[n].foreign_keys)} for n in sorted(set(tables)) if n in CATALOG}
