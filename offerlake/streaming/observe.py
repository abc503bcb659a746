"""Streams of price observations: snapshots appended, duplicates dropped within a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def observations(spark: SparkSession, path: str, schema) -> DataFrame:
    """New files of a folder as a stream; scraped_at becomes a timestamp with a zone, which watermarks need."""
    return spark.readStream.schema(schema).parquet(path).withColumn("scraped_at", F.col("scraped_at").cast("timestamp"))


def snapshots(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Each (sid, pid, scraped_at) once."""
    return stream.withWatermark("scraped_at", late).dropDuplicatesWithinWatermark(["sid", "pid", "scraped_at"])


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """All that is there now, batch by batch; a batch that fails is tried again from the checkpoint."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
