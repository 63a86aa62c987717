"""Files arriving in a folder to records, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def watch(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None], schema: str, header: bool = True) -> StreamingQuery:
    """Hand every new CSV file's rows to ``handle`` once, and stop when there are none left."""
    rows = spark.readStream.schema(schema).option("header", header).csv(folder).withColumn("file", F.col("_metadata.file_path"))
    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
