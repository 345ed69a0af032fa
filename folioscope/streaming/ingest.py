"""Documents that arrive as files: an append-only stream, each content once, checked batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, late: str = "1 day") -> DataFrame:
    """Files of a folder as they arrive, with their digest; copies within the watermark are dropped, so state is bounded."""
    rows = spark.readStream.format("binaryFile").schema(SCHEMA).load(folder)
    return rows.withColumn("digest", F.sha2("content", 256)).withWatermark("modificationTime", late).dropDuplicatesWithinWatermark(["digest"])


def audited(stream: DataFrame, audit: Callable[[DataFrame], DataFrame], to: str, checkpoint: str) -> StreamingQuery:
    """Runs audit on each batch that arrives and appends its rows to a table at to; a batch that is run again replaces its own rows."""

    def each(batch: DataFrame, number: int) -> None:
        audit(batch).write.mode("overwrite").parquet(f"{to}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events (ts, stage, value) counted by window and stage, with late ones up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "stage").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
