"""Where intermediate tables go: a folder that the driver and the executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Stand-ins for spark.checkpoint.dir by application, for local sessions that don't set it.
OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir.

    Where the setting is absent, a local session (one machine) gets a temporary folder, and a cluster an error: its
    executors would write to disks of their own.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        root = OWN.get(sc.applicationId) or OWN.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="folioforge-"))
    if root.startswith("/"):
        root = f"file://{root}"
    return f"{root.rstrip('/')}/folioforge-{sc.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: later jobs restart from there.

    Executors may be lost afterwards, and nothing above is computed twice.
    """
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(*tables: DataFrame) -> None:
    """Delete written tables that no later result reads."""
    for t in tables:
        _delete(t.sparkSession, t.scratch_path)


def discard(spark: SparkSession) -> None:
    """Delete every intermediate table of this application; for callers that have stored their results."""
    _delete(spark, shared_dir(spark))
