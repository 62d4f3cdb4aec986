"""Structured Streaming over an event folder: deduplicated counts, tumbling windows, sessions.

Each function takes a streaming (or batch) DataFrame and returns one; `drained` runs what has arrived and
returns the result as a batch DataFrame.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "1 day"


def event_stream(spark: SparkSession, sf_dir: str, per_batch: int = 8) -> DataFrame:
    """The events table as a file stream; ts becomes a timestamp, as watermarks need it."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).option("pathGlobFilter", "*events*").parquet(sf_dir)
    return files.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame) -> DataFrame:
    """Events of overlapping files once: state is bounded by the watermark."""
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"])


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", LATE).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") * 100 + 0.5).cast("long")).alias("cents")).select(F.col("window.start").alias("start"), "event_type", "n", "cents")


def sessions(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")


def drained(stream: DataFrame, folder: str, keys: list[str] | None = None) -> DataFrame:
    """Runs all available input and returns the result.

    With keys, each batch appends the groups that it changed and the last version of a group counts, so that the
    watermark frees closed groups. Without (sessions, whose keys move), each batch writes the complete result.
    """
    path = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = stream.schema

    def add(df: DataFrame, batch: int) -> None:
        # a repeated batch overwrites its own folder
        df.write.mode("overwrite").parquet(f"{path}/result/batch={batch}" if keys else f"{path}/result")

    query = stream.writeStream.outputMode("update" if keys else "complete").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(add).start()
    query.awaitTermination()
    if not keys:
        return stream.sparkSession.read.schema(schema).parquet(f"{path}/result")
    d = stream.sparkSession.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, batch long").parquet(f"{path}/result")
    rest = [c for c in schema.names if c not in keys]
    last = d.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in schema.names])
