"""Lot valuation, holdings, and the summaries over them. A null value is unknown, never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.domain import half_up


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    """a / b rounded half up, null where b is zero or null."""
    return half_up(F.try_divide(a.cast("double"), b.cast("double")), digits)


def valued(lots: DataFrame) -> DataFrame:
    """lots (quantity, cost, bought, price, prev_price, prev_quantity) with value, lot_cost, prev_value, pl.

    value is unknown without a price; the previous value only counts if it comes by the same route. A lot
    that is zero today and was zero before is dropped; one that went to zero today stays for the day's change.
    """
    prev_q = F.coalesce("prev_quantity", "quantity")
    d = lots.where(~((F.col("quantity") == 0) & (prev_q == 0)))
    value = F.col("quantity") * F.col("price")
    lot_cost = F.when(F.col("bought") > 0, F.expr("quantity * cost div bought"))
    prev = F.when(F.col("price").isNotNull(), prev_q * F.col("prev_price"))
    d = d.withColumns({"value": value, "lot_cost": lot_cost, "prev_value": prev})
    return d.withColumns({"pl": F.col("value") - F.col("lot_cost"), "day_change": F.col("value") - F.col("prev_value")})


def rolled_up(lots: DataFrame, *keys: str) -> DataFrame:
    """Totals per key: sums of what is known, the cost basis of valued lots only, flags, and the share of all value."""
    costed = F.col("lot_cost").isNotNull() & F.col("value").isNotNull()
    g = lots.groupBy(*keys).agg(
        F.sum("value").alias("value"), F.sum(F.when(costed, F.col("lot_cost"))).alias("cost"), F.sum(F.when(costed, F.col("pl"))).alias("pl"), F.sum("day_change").alias("day_change"),
        F.bool_or(F.col("value").isNotNull() & F.col("day_change").isNull()).alias("day_change_partial"), F.count("*").alias("lots"), F.countDistinct("security_id").alias("holdings"),
    )
    total = g.agg(F.sum("value").alias("_total"))
    return g.join(F.broadcast(total)).withColumn("weight", ratio(F.col("value"), F.col("_total"))).withColumn("pl_pct", ratio(F.col("pl") * 100, F.col("cost"), 2)).drop("_total")


def merged_by_security(lots: DataFrame) -> DataFrame:
    """Accounts merged: weighted average cost, the day's change only if every valued lot has one, a breakdown by account."""
    complete = F.count("value") == F.count("day_change")
    return lots.groupBy("security_id").agg(
        F.sum("quantity").alias("quantity"), F.sum("value").alias("value"), F.sum("lot_cost").alias("cost"), F.when(complete, F.sum("day_change")).alias("day_change"),
        ratio(F.sum(F.when(F.col("lot_cost").isNotNull(), F.col("lot_cost"))), F.sum(F.when(F.col("lot_cost").isNotNull(), F.col("quantity")))).alias("avg_cost"),
        F.count("*").alias("accounts"), F.max_by("account_id", F.struct("value", "account_id")).alias("largest_account"),
    )


def top_nulls_last(df: DataFrame, by: str, ties: list[str], n: int) -> DataFrame:
    """The n first rows by falling value, unknown values last."""
    return df.orderBy(F.desc_nulls_last(by), *ties).limit(n)


def others(parts: DataFrame, label: str, value: str, least: float) -> DataFrame:
    """Parts below the share `least` become one 'others' row, if there are two or more of them."""
    everything = Window.partitionBy()
    d = parts.withColumn("_share", F.try_divide(F.col(value).cast("double"), F.sum(value).over(everything)))
    small = F.coalesce(F.col("_share") < least, F.lit(False))
    d = d.withColumn("_fold", small & (F.sum(small.cast("int")).over(everything) >= 2))
    return d.groupBy(F.when(F.col("_fold"), "others").otherwise(F.col(label)).alias(label)).agg(F.sum(value).alias(value), F.count("*").alias("parts"))
