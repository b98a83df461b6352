"""An append-only log of JSON lines."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ts double, type string, event string"


class EventLog:
    """Appends events to a folder; each append is one atomic file commit of Spark's JSON sink."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, *events: dict) -> None:
        rows = [(e.get("type"), json.dumps(e, ensure_ascii=False)) for e in events]
        df = self.spark.createDataFrame(rows, "type string, event string")
        self.append(df)

    def append(self, df: DataFrame) -> None:
        stamped = df.select(F.unix_micros(F.current_timestamp()).cast("double").__truediv__(1e6).alias("ts"), "type", "event")
        stamped.write.mode("append").json(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).json(self.path)
