"""Counts of molecules that arrive as files, kept up to date batch by batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def count_stream(stream: DataFrame, keys: list[Column], path: str, checkpoint: str) -> StreamingQuery:
    """Takes in all that has arrived; each batch's counts are written to a folder of its own.

    A batch that is run again after a failure overwrites its folder, so that nothing counts twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, path: str) -> DataFrame:
    """The counts of all batches so far."""
    rows = spark.read.parquet(path).drop("batch")
    return rows.groupBy(*(c for c in rows.columns if c != "n")).agg(F.sum("n").alias("n"))
