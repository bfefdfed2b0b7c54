"""Landed rows as a stream: new keys once, written by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_rows(spark: SparkSession, folder: str, schema, key: str, time: str, late: str = "1 day", pattern: str | None = None) -> DataFrame:
    """Stream of the rows of Parquet files in ``folder``, each key once within the watermark."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    stamped = reader.parquet(folder).withColumn(time, F.col(time).cast("timestamp"))
    return stamped.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def append(rows: DataFrame, folder: str, state: str) -> StreamingQuery:
    """Appends all rows that have landed to Parquet files, once each across restarts, then ends."""
    return rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", state).trigger(availableNow=True).start()


def each_batch(rows: DataFrame, state: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Calls ``write`` (batch, number) for each micro-batch of what has landed, then ends: for merges into tables."""
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
