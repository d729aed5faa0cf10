"""A cache of external results as a table that is bucketed by key.

Every write keeps each key in the file of its bucket, so a lookup shuffles what is asked and never the cache, which only
grows. The table is its folder: any session that opens the same folder with the same number of buckets reads it.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.generate import call_missing


class BucketedCache:
    """Rows (key, value) at `path`; of rows with one key the last one written counts. `kind` is the type of values, and the
    number of buckets must stay what it was when the first row was written."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "string", buckets: int = 256):
        self.spark, self.kind, self.buckets = spark, kind, buckets
        self.table = f"cache_{uuid.uuid4().hex}"
        place = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE {self.table} (key STRING, value {kind}, written BIGINT) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{place}'")

    def append(self, rows: DataFrame) -> None:
        """Write rows (key, value), a file for each bucket; keys and values that are null are no entries."""
        new = rows.where("key is not null and value is not null").select("key", F.col("value").cast(self.kind).alias("value"), F.lit(time.time_ns()).alias("written"))
        new.repartition(self.buckets, "key").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def rows(self) -> DataFrame:
        """(key, value): one row for each key, aggregated within the buckets."""
        return self.spark.table(self.table).groupBy("key").agg(F.max_by("value", F.struct("written", F.hash("value"))).alias("value"))

    def missing(self, asked: DataFrame) -> DataFrame:
        """Rows of asked (key, ...) whose key the cache lacks, each key once; null keys are none."""
        # Bucketed as the cache is, so dropping duplicates and the lookup take one shuffle together.
        each = asked.where("key is not null").repartition(self.buckets, "key").dropDuplicates(["key"])
        return each.join(self.spark.table(self.table).select("key").hint("merge"), "key", "left_anti")

    def get(self, asked: DataFrame) -> DataFrame:
        """Rows of asked (key, ...) with the value that the cache has for their key, or null."""
        return asked.join(self.rows().hint("merge"), "key", "left")

    def fill(self, asked: DataFrame, call: Callable[[list[str]], list], batch: int = 96) -> None:
        """Add the results of an external call for those of asked (key, text) that the cache lacks."""
        self.append(call_missing(self.missing(asked.select("key", "text")), None, call, self.kind, batch))

    def close(self) -> None:
        """Forget the table in this session; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
