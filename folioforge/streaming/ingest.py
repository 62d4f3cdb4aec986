"""Incremental ledger ingest: a folder of Parquet files becomes a deduplicated table.

A row's key is a hash of its content and its occurrence number inside the file, so that overlapping exports add
only what is new and equal trades of one export stay apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def keyed(rows: DataFrame, content: list[str], file: str = "_file") -> DataFrame:
    """rows with dedup_key; the number of a row among equal ones of its file is part of it."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in content])
    d = rows.withColumn("_text", text)
    n = F.row_number().over(Window.partitionBy(file, "_text").orderBy("_text")) - 1
    return d.withColumn("dedup_key", F.sha2(F.concat_ws("|", "_text", n.cast("string")), 256)).drop("_text")


def ingest(spark: SparkSession, folder: str, schema: StructType, table: str, state: str, content: list[str]) -> None:
    """Appends what has arrived in folder and is new to table (a Parquet path). Files are read once; a batch that
    fails is repeated whole, and rows that it had written are then no longer new."""
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(folder).withColumn("_file", F.col("_metadata.file_path"))

    def add(batch: DataFrame, _: int) -> None:
        first = keyed(batch, content).dropDuplicates(["dedup_key"])
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        new = first.join(spark.read.parquet(table).select("dedup_key"), "dedup_key", "left_anti") if there else first
        new.drop("_file").write.mode("append").parquet(table)

    files.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(add).start().awaitTermination()
