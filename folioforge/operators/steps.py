"""What a transaction of any type is worth and does to a position. Zero amounts mean that nothing was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import amount, compatible

ACQUIRES, LEAVES = ("buy", "reinvest", "transfer_in"), ("sell", "transfer_out")


def _some(name: str) -> Column:
    return F.when(F.col(name) != 0, F.abs(name))


def trade_amount() -> Column:
    """Gross; else net less (purchases) or plus costs; else quantity x unit price; else 0."""
    costs = F.coalesce(F.abs("fee"), F.lit(0)) + F.coalesce(F.abs("tax"), F.lit(0))
    net = F.when(F.col("kind").isin("buy", "reinvest"), _some("net_amount") - costs).otherwise(_some("net_amount") + costs)
    return F.coalesce(_some("gross_amount"), net, F.abs("quantity") * F.abs("unit_price"), F.lit(0))


def proceeds(divisor: str = "divisor") -> Column:
    """The trade amount; only the fallback to quantity x unit price is divided."""
    fallback = _some("gross_amount").isNull() & _some("net_amount").isNull() & F.col("unit_price").isNotNull()
    return F.when(fallback, trade_amount() / F.col(divisor)).otherwise(trade_amount().cast("double"))


def acquisition_cost(divisor: str = "divisor") -> Column:
    return proceeds(divisor) + F.coalesce(F.abs("fee"), F.lit(0))


def quantity_step() -> Column:
    """struct(mult, delta): the position after is mult x before + delta; null for types that don't move it. Signs go by type."""
    q, kind = F.coalesce(F.abs("quantity"), F.lit(0)).cast("double"), F.col("kind")
    step = lambda m, d: F.struct(m.cast("double").alias("mult"), d.cast("double").alias("delta"))
    one, none = F.lit(1.0), F.lit(0.0)
    return (
        F.when(kind.isin(*ACQUIRES), step(one, q)).when(kind.isin(*LEAVES), step(one, -q)).when((kind == "split") & (F.col("split_ratio") > 0), step(F.col("split_ratio"), none))
        .when((kind == "split") & F.col("quantity").isNotNull(), step(one, F.col("quantity")))
    )


def composed(tx: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """alpha, beta per key: the position after all steps is alpha x the opening one + beta.

    Steps are composed per key and month first and the months then, so that a key with very many rows spreads.
    """
    d = tx.withColumn("_s", quantity_step()).where("_s is not null").withColumn("_m", F.trunc("trade_date", "MM"))

    def level(d: DataFrame, by: list[str], order: list[str], mult: Column, delta: Column) -> DataFrame:
        later = Window.partitionBy(*by).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
        d = d.withColumn("_later", F.exp(F.coalesce(F.sum(F.ln(mult)).over(later), F.lit(0.0))))
        return d.groupBy(*by).agg(F.exp(F.sum(F.ln(mult))).alias("alpha"), F.sum(delta * F.col("_later")).alias("beta"))

    months = level(d, [*keys, "_m"], order, F.col("_s.mult"), F.col("_s.delta"))
    return level(months, keys, ["_m"], F.col("alpha"), F.col("beta"))


def split_ratio(text: Column) -> Column:
    """New over old from 1:3, 1：3 and 1対3, in any width of digits, or from a single positive number; null if it is neither."""
    t = F.trim(compatible(text))
    a, b = (F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)\s*[:：対]\s*([0-9]+(?:\.[0-9]+)?)$", i).try_cast("double") for i in (1, 2))
    one = amount(t).cast("double")
    return F.when(a > 0, b / a).when(a.isNull() & (one > 0), one)
