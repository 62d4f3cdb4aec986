"""Latest-row and as-of operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: str, until: Column | None = None, strict: bool = False) -> DataFrame:
    """The row with the largest `order` per key, optionally up to (strict: before) a day.

    An aggregate, not a window: it combines before the shuffle, so a key with very many rows is no task's burden.
    """
    if until is not None:
        df = df.where(F.col(order) < until if strict else F.col(order) <= until)
    rest = [c for c in df.columns if c not in keys]
    row = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
    return row.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def latest_at(df: DataFrame, keys: list[str], order: str, days: dict[str, Column]) -> DataFrame:
    """The latest row per key at each of several days, as structs of those names, in one aggregate; null where there is none."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[F.max_by(F.struct(*rest), F.when(F.col(order) <= day, F.col(order))).alias(name) for name, day in days.items()])


def intervals(series: DataFrame, keys: list[str], date: str, backfill: bool = False) -> DataFrame:
    """The series with valid_from and valid_to (exclusive; null: open). backfill: the first row also holds before."""
    w = Window.partitionBy(*keys).orderBy(date)
    first = F.row_number().over(w) == 1
    start = F.when(first, F.lit("0001-01-01").cast("date")).otherwise(F.col(date)) if backfill else F.col(date)
    return series.withColumn("valid_from", start).withColumn("valid_to", F.lead(date).over(w))


def as_of(left: DataFrame, series: DataFrame, keys: list[str], left_date: str, date: str, values: list[str], backfill: bool = False, strict: bool = False, max_days: int | None = None) -> DataFrame:
    """left with the series' values in force at left_date (strict: the last before it), null where there are none.

    An equi-join on the keys and the month: a value stands in every month of the lookups in which it is in force, so a key with very many
    lookups is cut by months, and a lookup meets its month's values only. max_days leaves out values that are older.
    """
    span = left.agg(F.min(left_date).alias("_lo"), F.max(left_date).alias("_hi"))
    s = intervals(series.select(*keys, date, *values), keys, date, backfill).join(F.broadcast(span))  # one row
    start, end = F.greatest("valid_from", "_lo"), F.least(F.coalesce("valid_to", "_hi"), "_hi")
    s = s.where(start <= end).withColumn("_month", F.explode(F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("interval 1 month"))))
    s = s.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(date).alias("_date"), "_month", "valid_from", "valid_to", *[F.col(v).alias(f"_{v}") for v in values])
    d = F.col(left_date)
    inside = (F.col("valid_from") < d) & (F.col("valid_to").isNull() | (d <= F.col("valid_to"))) if strict else (F.col("valid_from") <= d) & (F.col("valid_to").isNull() | (d < F.col("valid_to")))
    if max_days is not None:
        inside &= F.datediff(d, F.col("_date")) <= max_days
    inside &= F.trunc(d, "MM") == F.col("_month")
    for k in keys:
        inside &= F.col(k) == F.col(f"_{k}")
    return left.join(s, inside, "left").select(*left.columns, *[F.col(f"_{v}").alias(v) for v in values], F.col("_date").alias(f"{date}_found"))
