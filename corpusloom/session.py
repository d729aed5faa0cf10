"""Session settings that the engine's expressions rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound Arrow batches, so a run of long documents cannot fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def configure(spark: SparkSession) -> SparkSession:
    """Later map entries win, times are UTC, plans adapt at run time, Arrow batches are bounded."""
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    bounded_batches(spark)
    return spark
