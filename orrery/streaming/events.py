"""Streaming extensions: windowed counts with watermarks, and drift of snapshots that arrive as files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import relational as R
from ..storage import shared_folder


def windowed(events: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, event_type, n and total value by tumbling window; on streams events later than ``late`` are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """user_id, start, and n of the events between pauses of ``gap``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def first_seen(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, whatever how often it is delivered within ``late``."""
    if events.isStreaming:
        return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def files(spark: SparkSession, folder: str, schema: StructType, pattern: str | None = None, per_trigger: int = 16) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(folder)


def drained(stream: DataFrame, mode: str = "append", where: str | None = None) -> DataFrame:
    """All that a stream of files gives now, by way of files in the shared folder: the sink remembers what it wrote."""
    spark = stream.sparkSession
    base = where or f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    else:  # the last complete result replaces those before it
        write = lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def drift(snapshots: DataFrame, baseline: DataFrame, where: str) -> None:
    """For every batch of elements that arrives, the difference from ``baseline`` is appended to ``where``/changes."""

    def compare(batch: DataFrame, number: int) -> None:
        R.difference(baseline, batch).withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{where}/changes")

    snapshots.writeStream.foreachBatch(compare).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
