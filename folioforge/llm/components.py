"""Connected components over an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def components(edges: DataFrame) -> DataFrame:
    """v, label (the smallest vertex that v reaches) for every vertex of edges (a, b).

    A round takes the smallest label next to each vertex, aggregated before the shuffle, and then the
    label's own label, so long chains halve. Each round is written, so lost executors cost one round.
    """
    e = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(e.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    before = None
    while True:
        total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)")).alias("s")).first().s
        if total == before:
            forget(e)
            return labels
        before = total
        near = e.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        lower = written(labels.join(near, "v", "left").select("v", F.least("label", F.coalesce("near", "label")).alias("label")), "labels")
        jump = lower.select(F.col("v").alias("label"), F.col("label").alias("next"))
        old, labels = labels, written(lower.join(jump, "label", "left").select("v", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        forget(old, lower)
