"""Shared helpers: the cluster's shared folder, staged tables, table reading."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only where the setting is absent and Spark runs in one process (tests) is a
    local folder made and recorded in the session's configuration; on a cluster
    the executors couldn't see it, so there the setting is required.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        local = tempfile.mkdtemp(prefix="whyframe-")
        atexit.register(shutil.rmtree, local, True)
        found = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts are cut by bytes, not by rows alone; a smaller setting stays."""
    size = spark.conf.get(BATCH, "64m").lower().rstrip("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    value = int(size[:-1]) * unit[size[-1]] if size[-1:] in unit else int(size)
    if value > BATCH_BYTES or value <= 0:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a staged table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table cuts the lineage and outlives any executor. Shuffle
    files of the finished write are released at once.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    bound_batches(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def stage_bucketed(df: DataFrame, name: str, key: str, rows: int) -> DataFrame:
    """As ``stage``, dealt by ``key`` into buckets of about ``rows`` rows, as many as Spark allows: joins by the key don't shuffle it again."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    n = min(max(partitions(spark), -(-df.count() // rows)), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    table_name = f"whyframe_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).format("parquet").saveAsTable(table_name)
    out = spark.table(table_name)
    out._staged_path, out._staged_table, out._buckets = path, table_name, n
    return out


def unstage(*frames: DataFrame) -> None:
    for df in frames:
        if getattr(df, "_staged_table", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._staged_table}")
        path = getattr(df, "_staged_path", None)
        if path:
            drop_path(df.sparkSession, path)


def bounded_sample(df: DataFrame, key: F.Column, n: int, total: int | None = None) -> DataFrame:
    """The n rows with the smallest hash of their key, the same on every run.

    Where there are many more rows, those far from the smallest hashes are left
    out by a threshold first, so that about 4 n rows reach the final sort and
    not n from every task.
    """
    total, h, span = df.count() if total is None else total, F.xxhash64(key), 1 << 30
    near = df.where(F.pmod(h, F.lit(span)) < int(span * 4 * n / total)) if total > 8 * n else df
    return near.orderBy(F.pmod(h, F.lit(span)), h, key).limit(n)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_id(name: str) -> F.Column:
    return F.col(f"`{name}`").cast("long")
