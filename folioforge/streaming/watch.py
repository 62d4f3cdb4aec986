"""A watched folder as a stream of listings: files that no longer change, and what of their previews may be accepted.

Each scan of the folder is rows (scan, seen_at, name, size, mtime). A file is ready when two scans after each other
show it alike, once for each form it takes; one that a scan doesn't show starts anew.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LISTING = "scan long, seen_at timestamp, name string, size long, mtime long"
READY = "name string, scan long, size long, mtime long"
#: Of each file of a bucket: its name, scan, the form that waits and the form that was reported last (null sizes for none), and when it is dropped.
FILE = ("name", "scan", "size", "mtime", "done_size", "done_mtime", "until")
STATE = ", ".join(f"{c} array<{'string' if c == 'name' else 'long'}>" for c in FILE)
#: Files are kept by hash in so many buckets, so that what a call of Python costs is paid once a bucket and batch, not once a file.
BUCKETS = 512
#: Scans may come so late; what a file was is kept for so many polls after it was last seen.
LATE, POLLS = "1 hour", 2


def settled(rows: list[tuple[int, int, int]], scan: int | None, waits: tuple | None, done: tuple | None) -> tuple[list[tuple[int, int, int]], int | None, tuple | None, tuple | None]:
    """(what becomes ready, and the state after) of one file's rows (scan, size, mtime), in order of scans; a scan counts once."""
    out = []
    for at, size, mtime in sorted(rows):
        if scan is not None and at <= scan:
            continue
        if scan is None or at != scan + 1:
            waits = done = None
        if done != (size, mtime):
            if waits == (size, mtime):
                out.append((at, size, mtime))
                waits, done = None, (size, mtime)
            else:
                waits = (size, mtime)
        scan = at
    return out, scan, waits, done


def ready_files(listings: DataFrame, poll_seconds: int) -> DataFrame:
    """READY rows of a stream (or table) of LISTING rows. State is one small entry a file, dropped POLLS polls after it was last seen."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        files = {n: x for n, *x in zip(*state.get, strict=True)} if state.exists else {}
        rows, latest, ready = defaultdict(list), {}, []
        if not state.hasTimedOut:
            for p in parts:
                seen = (p["seen_at"].astype("datetime64[ms]").astype("int64")).tolist()
                for n, at, *row in zip(p["name"].tolist(), seen, p["scan"].tolist(), p["size"].tolist(), p["mtime"].tolist(), strict=True):
                    rows[n].append(tuple(row))
                    latest[n] = max(latest.get(n, 0), at)
        pair = lambda a, b: None if a is None else (a, b)
        for n, own in rows.items():
            scan, *form, _ = files.get(n, (None,) * 6)
            out, scan, waits, done = settled(own, scan, pair(*form[:2]), pair(*form[2:]))
            ready += [(n, *r) for r in out]
            files[n] = (scan, *(waits or (None, None)), *(done or (None, None)), max(latest[n], now) + POLLS * poll_seconds * 1000 + 1)
        files = {n: x for n, x in files.items() if n in rows or x[-1] >= now}
        if files:
            state.update(tuple(map(list, zip(*((n, *x) for n, x in files.items()), strict=True))))
            state.setTimeoutTimestamp(max(min(x[-1] for x in files.values()), now + 1))
        else:
            state.remove()
        if ready:
            yield pd.DataFrame(ready, columns=["name", "scan", "size", "mtime"])

    d = listings.where("name is not null and size is not null and mtime is not null").withWatermark("seen_at", LATE)
    return d.withColumn("bucket", F.pmod(F.xxhash64("name"), F.lit(BUCKETS))).groupBy("bucket").applyInPandasWithState(step, READY, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def drained_ready(listings: DataFrame, folder: str, poll_seconds: int) -> DataFrame:
    """Runs what has arrived and returns the ready files; batches that are repeated overwrite their own folder."""
    spark, path = listings.sparkSession, f"{folder.rstrip('/')}/watch-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/ready/batch={n}")

    stream = ready_files(listings, poll_seconds).writeStream.outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    stream.foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(f"{READY}, batch long").parquet(f"{path}/ready").drop("batch")


def accepted(previews: DataFrame, sections: DataFrame, rows: DataFrame) -> DataFrame:
    """batch, accepted, reasons, sections, excluded, zeroed: what of an import's preview can be committed without a person.

    previews: batch, total_ok (null: not checked); sections: batch, section, included, sums_ok (null counts as right);
    rows: batch, key, section, status, included (null counts as included). Reasons against it: nothing to include, a wrong total, sections
    whose sums don't agree. excluded: keys of included sections that are not included themselves; zeroed: keys that
    are missing from the statement and were included. A batch without rows or sections has empty lists.
    """
    key = "batch"
    s = sections.groupBy(key).agg(
        F.sort_array(F.collect_set(F.when(F.col("included"), F.col("section")))).alias("sections"), F.sort_array(F.collect_set(F.when(~F.coalesce("sums_ok", F.lit(True)), F.col("section")))).alias("wrong")
    )
    inside = rows.join(sections.where("included").select(key, "section").distinct(), [key, "section"], "left_semi")
    kept, gone = F.coalesce("included", F.lit(True)), F.col("status") == "missing"
    r = inside.groupBy(key).agg(F.count_if(~gone & ~kept).alias("excluded"), F.count_if(gone & kept).alias("zeroed"))
    none = F.array().cast("array<string>")
    d = previews.join(s, key, "left").join(r, key, "left").withColumn("sections", F.coalesce("sections", none)).withColumn("wrong", F.coalesce("wrong", none))
    reason = lambda test, text: F.when(test, text if isinstance(text, Column) else F.lit(text))
    reasons = F.array_compact(F.array(reason(F.size("sections") == 0, "nothing to include"), reason(~F.coalesce("total_ok", F.lit(True)), "total"), reason(F.size("wrong") > 0, F.concat(F.lit("sections "), F.array_join("wrong", ",")))))
    d = d.withColumn("reasons", reasons)
    return d.select(key, (F.size("reasons") == 0).alias("accepted"), "reasons", "sections", F.coalesce("excluded", F.lit(0)).cast("long").alias("excluded"), F.coalesce("zeroed", F.lit(0)).cast("long").alias("zeroed"))
