"""Row texts, vector search by exact L2 distance, capped retrieval, table matching."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.catalog import aliases_frame, references_frame
from ..sources.tables import RID, tagged

# Defaults of the retrieval.
TOP_K = 40
MAX_ROWS = 10
MAX_TABLES = 4


def row_text(columns: list[str]) -> Column:
    """``column: value`` parts joined by `` | ``; values are trimmed, blank ones and row ids left out."""
    value = lambda c: F.trim(F.col(f"`{c}`").cast("string"))
    parts = [F.when(value(c) != "", F.concat(F.lit(f"{c}: "), value(c))) for c in columns if c != RID and not c.endswith("_rownum")]
    return F.concat_ws(" | ", *parts)


def index_documents(tables: dict[str, DataFrame], allow: list[str] | None = None, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """(table_name, rid, text[, embedding]) of every row of the allowed tables (all, if none are named)."""
    out = None
    for name, df in sorted(tables.items()):
        if allow and name not in allow:
            continue
        part = tagged(df, name).select(F.lit(name).alias("table_name"), F.col(RID).alias("rid"), row_text(df.columns).alias("text"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no table to index")
    return out if embed is None else out.withColumn("embedding", embed(F.col("text")))


def save_index(documents: DataFrame, path: str, rows_per_file: int = 1_000_000) -> DataFrame:
    """Write an index and read it back; rows without text are left out, an empty index is an error.

    Rows are embedded and written task by task in record batches, so no batch
    grows with the table; files hold at most ``rows_per_file`` rows.
    """
    documents.where(F.col("text") != "").write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)
    saved = documents.sparkSession.read.parquet(path)
    if saved.isEmpty():
        raise ValueError("no rows to index")
    return saved


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], note: Callable[..., None] = lambda kind, **fields: None) -> DataFrame:
    """The index saved at a path; where there is none, or it can't be read, it is built and saved."""
    try:
        saved = spark.read.parquet(path)
        if not {"table_name", "rid", "text"} <= set(saved.columns):
            raise ValueError("not an index")
        note("index_loaded", path=path)
        return saved
    except (AnalysisException, ValueError, Py4JJavaError) as e:
        note("index_not_loaded", path=path, error=str(e).split("\n")[0][:200])
    saved = save_index(build(), path)
    note("index_built", path=path, rows=saved.count())
    return saved


def l2_squared(a: Column, b: Column) -> Column:
    """Squared Euclidean distance in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, d: s + d)


def vector_top_k(vectors: DataFrame, query: Column, k: int = TOP_K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest vectors, ties by id: a bounded top-k in each task, merged."""
    return vectors.select(id_col, l2_squared(F.col(vec_col), query).alias("distance")).orderBy("distance", id_col).limit(k)


def vector_top_k_batch(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 4096) -> DataFrame:
    """The k nearest other vectors of each query (q_id, q_vec).

    Queries are counted first and sent to the executors in blocks of about
    ``block``, so a broadcast never grows with their number. Each task passes
    its vectors by the block's queries and holds the k nearest of each so far,
    whatever the number of vectors; only these are shuffled and ranked.

    Distances are in double precision, summed in the order of the components.
    A vector that is null, holds nulls or has another length than the query has
    a null distance, which ranks first, as in Spark's ascending order.
    """
    sc, blocks = vectors.sparkSession.sparkContext, max(1, -(-queries.count() // block))
    order, out = Window.partitionBy("q_id").orderBy("distance", "__id"), None
    plain = vectors.select(F.col(id_col).alias("__id"), F.col(vec_col).cast("array<double>").alias("__vec")).where("__id IS NOT NULL")
    asked = queries.select("q_id", F.col("q_vec").cast("array<double>").alias("q_vec")).where("q_id IS NOT NULL")
    schema = f"q_id {asked.schema['q_id'].dataType.simpleString()}, __id {plain.schema['__id'].dataType.simpleString()}, distance double"
    for b in range(blocks):
        some = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("q_id"), F.lit(blocks)) == b)
        found = some.toArrow()  # about a block of queries
        part = plain.mapInArrow(_nearest(sc.broadcast((found.column("q_id").combine_chunks(), _by_length(found.column("q_vec")))), k), schema)
        part = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q_id", F.col("__id").alias(id_col), "distance", "rank")
        out = part if out is None else out.unionByName(part)
    return out


def _by_length(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each length the rows of that length without nulls, and their vectors as a matrix."""
    lists = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
    if not len(lists):
        return {}
    size = np.asarray(pc.fill_null(pc.list_value_length(lists), -1))
    values, at = lists.flatten(), np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    holes = np.concatenate([[0], np.cumsum(np.asarray(values.is_null()))])
    whole = (size >= 0) & (holes[at + np.maximum(size, 0)] == holes[at])
    flat, out = values.fill_null(0.0).to_numpy(zero_copy_only=False), {}
    for n in np.unique(size[whole]).tolist():
        rows = np.flatnonzero(whole & (size == n))
        out[n] = rows, flat[at[rows][:, None] + np.arange(n)]
    return out


def _nearest(sent, k: int, cells: int = 1 << 20):
    """Of each query of a broadcast block the k nearest of a task's vectors, null distances first, ties by id."""

    def run(batches):
        asked, queries = sent.value
        q_ids, n = asked.to_numpy(zero_copy_only=False), len(asked)
        limit, step, kind = np.full(n, np.inf), max(1, cells // max(1, n)), None
        query, ids, distance = np.zeros(0, np.int64), None, np.zeros(0)
        for batch in batches if n else ():
            kind = batch.column(0).type
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                own, given = part.column(0).to_numpy(zero_copy_only=False), _by_length(part.column(1))
                low, high = np.full((len(own), n), -np.inf), np.full((len(own), n), -np.inf)
                for length, (rows, v) in given.items():
                    if length in queries:
                        columns, q = queries[length]
                        with np.errstate(all="ignore"):
                            norm = (v * v).sum(axis=1)[:, None] + (q * q).sum(axis=1)[None, :]
                            about = norm - 2 * (v @ q.T)  # within the slack of the exact distance
                            low[np.ix_(rows, columns)], high[np.ix_(rows, columns)] = about - 1e-9 * norm, about + 1e-9 * norm
                other = own[:, None] != q_ids[None, :]
                high[~other | np.isnan(high)] = np.inf
                if len(own) >= k:
                    limit = np.fmin(limit, np.partition(high, k - 1, axis=0)[k - 1])
                row, column = np.nonzero(other & ~(low > limit))
                exact = np.full(len(row), -np.inf)
                for length, (rows, v) in given.items():
                    if length in queries:
                        columns, q = queries[length]
                        place, column_of = np.full(len(own), -1), np.full(n, -1)
                        place[rows], column_of[columns] = np.arange(len(rows)), np.arange(len(columns))
                        pairs = np.flatnonzero((place[row] >= 0) & (column_of[column] >= 0))
                        a, b, total = place[row[pairs]], column_of[column[pairs]], np.zeros(len(pairs))
                        with np.errstate(all="ignore"):
                            for d in range(length):  # one after the other, as Spark's aggregate adds them
                                x = v[a, d] - q[b, d]
                                total += x * x
                        exact[pairs] = total
                query, distance = np.concatenate([query, column]), np.concatenate([distance, exact])
                ids = own[row] if ids is None else np.concatenate([ids, own[row]])
                order = np.lexsort((np.unique(ids, return_inverse=True)[1], distance, query))
                query, ids, distance = query[order], ids[order], distance[order]
                first = np.searchsorted(query, query, side="left")
                kept = np.arange(len(query)) - first < k
                query, ids, distance, first = query[kept], ids[kept], distance[kept], first[kept]
                full = np.flatnonzero(np.bincount(query, minlength=n) == k)
                limit[full] = np.fmin(limit[full], distance[np.searchsorted(query, full, side="right") - 1])
        for at in range(0, len(query), 8192):
            some = distance[at : at + 8192]
            yield pa.RecordBatch.from_arrays([asked.take(pa.array(query[at : at + 8192])), pa.array(ids[at : at + 8192], kind), pa.array(some, mask=some == -np.inf)], ["q_id", "__id", "distance"])

    return run


def capped(hits: DataFrame, index: DataFrame, max_rows: int = MAX_ROWS, max_tables: int = MAX_TABLES) -> DataFrame:
    """(rank, table_name, rid) of a bounded hit list (rank, rid): unknown ids go, the first tables stay, each row once.

    hits holds at most k rows, so the ranking windows are small by contract.
    """
    known = hits.join(index.select("rid", "table_name"), "rid")
    first = known.withColumn("first", F.min("rank").over(Window.partitionBy("table_name")))
    tables = first.withColumn("table_no", F.dense_rank().over(Window.orderBy("first"))).where(F.col("table_no") <= max_tables)
    once = tables.withColumn("n", F.row_number().over(Window.partitionBy("rid").orderBy("rank"))).where("n = 1")
    return once.orderBy("rank").limit(max_rows).select("rank", "table_name", "rid")


def relevant_tables(questions: DataFrame, text: str = "question", key: str = "id") -> DataFrame:
    """(key, table_name): tables a question names in any of their words, and what these refer to if it names several."""
    spark = questions.sparkSession
    q = questions.select(key, F.lower(text).alias("q"))
    named = q.join(F.broadcast(aliases_frame(spark)), F.expr("instr(q, alias) > 0")).select(key, "table_name").distinct()
    several = named.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select(key)
    more = named.join(several, key).join(F.broadcast(references_frame(spark)), "table_name").select(key, F.col("other").alias("table_name"))
    return named.unionByName(more).distinct()


def last_user_message(conversations: DataFrame) -> DataFrame:
    """(conv_id, question): the last user turn of each conversation, trimmed."""
    return conversations.where("role = 'user'").groupBy("conv_id").agg(F.trim(F.max_by("text", "turn")).alias("question"))
