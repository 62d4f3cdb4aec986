"""Calendars, step functions and date intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.domain import half_up


def spans(steps: DataFrame, keys: list[str], date: str, start: str, end: str) -> DataFrame:
    """A step function's rows with the days _from and _to, inside start and end, on which each holds; the first row also holds before."""
    w = Window.partitionBy(*keys).orderBy(date)
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    first = F.row_number().over(w) == 1
    d = steps.withColumn("_from", F.greatest(F.when(first, lo).otherwise(F.col(date)), lo)).withColumn("_to", F.least(F.coalesce(F.date_sub(F.lead(date).over(w), 1), hi), hi))
    return d.where(F.col("_from") <= F.col("_to"))


def span_days(d: DataFrame, date: str) -> DataFrame:
    """Spans day by day, flagged where the day is before the row's own (backfilled)."""
    return d.withColumn("day", F.explode(F.sequence("_from", "_to"))).withColumn("backfilled", F.col("day") < F.col(date)).drop("_from", "_to")


def on_calendar(steps: DataFrame, keys: list[str], date: str, start: str, end: str) -> DataFrame:
    """A step function on every day from start to end: each row is exploded over its own days, no join at all.

    A day before the first row has the first row's values (flag backfilled).
    """
    return span_days(spans(steps, keys, date, start, end), date)


def forward_filled(series: DataFrame, keys: list[str], date: str, value: str) -> DataFrame:
    """The series on every day between its first and last row, gaps filled with the last value; filled marks those."""
    w = Window.partitionBy(*keys).orderBy(date)
    end = F.coalesce(F.date_sub(F.lead(date).over(w), 1), F.col(date))
    d = series.withColumn("_end", end).select(*keys, F.col(date).alias("_at"), value, F.explode(F.sequence(F.col(date), F.col("_end"))).alias(date))
    return d.select(*keys, date, value, (F.col(date) > F.col("_at")).alias("filled"))


#: A range of days as one number: the day it starts on, and below it (32 bits) the day it ends on.
LOW, HALF = (1 << 32) - 1, 1 << 31


def first_day(packed: Column) -> Column:
    return F.shiftright(packed, 32).cast("int")


def last_day(packed: Column) -> Column:
    return (packed.bitwiseAND(LOW) - HALF).cast("int")


def _merged(ranges: Column) -> Column:
    """Packed ranges, sorted, with those that overlap or touch as one."""

    def add(a: Column, x: Column) -> Column:
        apart = first_day(x) > last_day(a["open"]) + 1
        longer = a["open"].bitwiseAND(~LOW) + F.greatest(a["open"].bitwiseAND(LOW), x.bitwiseAND(LOW))
        return F.struct(F.when(apart, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]).alias("done"), F.when(apart, x).otherwise(longer).alias("open"))

    return F.aggregate(ranges, F.struct(F.array().cast("array<long>").alias("done"), ranges[0].alias("open")), add, lambda a: F.concat(a["done"], F.array(a["open"])))


def packed_ranges(ranges: DataFrame, keys: list[str], start: str = "start_date", end: str = "end_date") -> DataFrame:
    """keys, ranges: the closed ranges of days of a key as sorted numbers, overlapping or adjacent (by one day) ones as one; inverted ones are left out.

    A key is one row of eight bytes a range, and equal ranges count once before they are shuffled, so that a task holds little of them. A key's different
    ranges, which its days bound, must fit a task.
    """
    one = F.shiftleft(F.unix_date(start).cast("long"), 32) + (F.unix_date(end).cast("long") + HALF)
    d = ranges.where(F.col(start) <= F.col(end)).groupBy(*keys).agg(F.sort_array(F.collect_set(one)).alias("ranges"))
    return d.withColumn("ranges", _merged(F.col("ranges")))


def merged_ranges(ranges: DataFrame, keys: list[str], start: str = "start_date", end: str = "end_date") -> DataFrame:
    """Overlapping or adjacent (by one day) closed ranges of days as one; inverted ranges are left out."""
    d = packed_ranges(ranges, keys, start, end).select(*keys, F.explode("ranges").alias("_range"))
    return d.select(*keys, F.date_from_unix_date(first_day(F.col("_range"))).alias(start), F.date_from_unix_date(last_day(F.col("_range"))).alias(end))


def missing_ranges(ranges: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """What the merged ranges leave uncovered of [start, end], per key."""
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    m = merged_ranges(ranges, keys).where((F.col("end_date") >= lo) & (F.col("start_date") <= hi))
    w = Window.partitionBy(*keys).orderBy("start_date")
    gap = m.select(*keys, F.coalesce(F.date_add(F.lag("end_date").over(w), 1), lo).alias("gap_start"), F.date_sub("start_date", 1).alias("gap_end"))
    tail = m.groupBy(*keys).agg(F.date_add(F.max("end_date"), 1).alias("gap_start")).withColumn("gap_end", hi)
    return gap.unionByName(tail.select(*keys, "gap_start", "gap_end")).where(F.col("gap_start") <= F.col("gap_end"))


def interpolated(index: DataFrame, keys: list[str], date: str, level: str, start: str, end: str) -> DataFrame:
    """A sparse index on every day: linear between points, null before the first, constant after the last; levels of 0 and less are no points."""
    w = Window.partitionBy(*keys).orderBy(date)
    hi = F.lit(end).cast("date")
    d = index.where(F.col(level) > 0).withColumn("_next", F.lead(date).over(w)).withColumn("_level", F.lead(level).over(w))
    d = d.withColumn("day", F.explode(F.sequence(F.col(date), F.greatest(F.col(date), F.coalesce(F.date_sub("_next", 1), hi)))))
    share = F.datediff("day", F.col(date)) / F.datediff("_next", F.col(date))
    at = F.when(F.col("_next").isNull(), F.col(level).cast("double")).otherwise(F.col(level) + (F.col("_level") - F.col(level)) * share)
    return d.where(F.col("day").between(F.lit(start).cast("date"), hi)).select(*keys, "day", half_up(at).alias("level"))


def chain_linked(anchors: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """Daily values between appraisals (keys, date, value) that follow an index (keys, day, level).

    Inside an interval the value is the anchor times the index ratio, and the drift against the next anchor is
    spread evenly over the days, so that anchors are hit exactly. Without an index at either end it is linear.
    """
    w = Window.partitionBy(*keys).orderBy("date")
    a = anchors.withColumn("next", F.lead("date").over(w)).withColumn("next_value", F.lead("value").over(w)).where("next is not null")
    at = lambda name, on: index.select(*keys, F.col("day").alias(on), F.col("level").alias(name))
    a = a.join(at("i0", "date"), [*keys, "date"], "left").join(at("i1", "next"), [*keys, "next"], "left")
    a = a.withColumn("day", F.explode(F.sequence(F.col("date"), F.date_sub("next", 1))))
    a = a.join(index.select(*keys, "day", "level"), [*keys, "day"], "left")
    share = F.datediff("day", "date") / F.datediff("next", "date")
    linear = F.col("value") + (F.col("next_value") - F.col("value")) * share
    grown = lambda level: F.col("value") * F.col(level) / F.col("i0")
    linked = grown("level") + (F.col("next_value") - grown("i1")) * share
    known = F.col("i0").isNotNull() & F.col("i1").isNotNull() & F.col("level").isNotNull()
    return a.select(*keys, "day", half_up(F.when(known, linked).otherwise(linear), 2).alias("value"), known.alias("indexed"))
