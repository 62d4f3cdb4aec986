"""Ledger arithmetic. A moving-average cost pool is an affine function of what came before, so the replay is a
composition of affine steps: running products and sums in windows, no row loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.domain import ORDER, half_up, signed

GROUP = ["account_id", "security_id"]
#: Width of a band of ln(share kept): exp(BAND) times any amount of money is a finite double.
BAND = 400


def running(tx: DataFrame, opening: int = 0) -> DataFrame:
    """Adds balance (after each transaction) and balance_before, in ledger order."""
    w = Window.partitionBy(*GROUP).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return tx.withColumn("balance", F.sum(signed()).over(w) + opening).withColumn("balance_before", F.col("balance") - signed())


def end_of_day(tx: DataFrame, opening: int = 0) -> DataFrame:
    """The balance at the end of each day with a transaction, from daily sums (one row a day enters the window)."""
    d = tx.groupBy(*GROUP, "trade_date").agg(F.sum(signed()).alias("change"), F.count("*").alias("trades"))
    w = Window.partitionBy(*GROUP).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.withColumn("balance", F.sum("change").over(w) + opening)


def pooled(tx: DataFrame, opening: int, opening_cost: Column) -> DataFrame:
    """Adds pool_a, pool_b (cost pool after each transaction = pool_a + pool_b * opening cost), pool and pool_before.

    Purchases add gross + fee; a sale keeps the share balance / balance_before. A balance of zero ends a
    segment: what follows starts from an empty pool. A group whose balance turns negative has null pools.

    With S the running sum of ln(share kept), a purchase counts exp(S now - S then). Rows are cut into bands of BAND nats of
    S, so that no exponent leaves the range of a double: inside a band shares refer to its start, and the band before
    counts as a whole. What is two bands back has shrunk by exp(-BAND), far below a cent.
    """
    d = running(tx, opening)
    sell = F.col("tx_type") == "sell"
    over = Window.partitionBy(*GROUP).orderBy(*ORDER)
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("segment", F.coalesce(F.sum((F.col("balance") == 0).cast("int")).over(before), F.lit(0)))
    d = d.withColumn("negative", F.min("balance").over(Window.partitionBy(*GROUP)) < 0)
    keeps = F.when(sell & (F.col("balance_before") > 0) & (F.col("balance") > 0), F.col("balance") / F.col("balance_before")).otherwise(1.0)
    seg = Window.partitionBy(*GROUP, "segment").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = F.when(sell, 0.0).otherwise((F.col("gross") + F.col("fee")).cast("double"))
    gone = sell & (F.col("balance") == 0)
    d = d.withColumn("kept_log", F.sum(F.ln(keeps)).over(seg)).withColumn("band", F.floor(-F.col("kept_log") / BAND))
    rise = F.col("kept_log") + F.col("band") * BAND  # in (-BAND, 0]
    banded = Window.partitionBy(*GROUP, "segment", "band").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("inside", F.exp(rise) * F.sum(added * F.exp(-rise)).over(banded))
    before_band = Window.partitionBy(*GROUP, "segment").orderBy("band").rangeBetween(-1, -1)
    d = d.withColumn("past", F.max_by(F.struct("inside", "kept_log"), F.struct(*ORDER)).over(before_band))
    carried = F.coalesce(F.col("past.inside") * F.exp(F.col("kept_log") - F.col("past.kept_log")), F.lit(0.0))
    d = d.withColumn("live_a", F.col("inside") + carried).withColumn("live_b", F.when(F.col("segment") == 0, F.exp("kept_log")).otherwise(0.0))
    known = ~F.col("negative")
    d = d.withColumn("pool_a", F.when(known, F.when(gone, 0.0).otherwise(F.col("live_a")))).withColumn("pool_b", F.when(known, F.when(gone, 0.0).otherwise(F.col("live_b"))))
    d = d.withColumn("pool", F.col("pool_a") + F.col("pool_b") * opening_cost)
    first = F.when(known, opening_cost.cast("double"))
    return d.withColumn("pool_before", F.coalesce(F.lag("pool").over(over), first)).drop("kept_log", "band", "inside", "past", "live_a", "live_b")


def realized(tx: DataFrame, opening: int, opening_cost: Column) -> DataFrame:
    """Moving-average result of each sale in cents: proceeds - fee - cost sold; tax is left out."""
    d = pooled(tx, opening, opening_cost).where(F.col("tx_type") == "sell")
    cost = F.try_divide(F.col("pool_before") * F.col("quantity"), F.col("balance_before"))
    return d.withColumn("cost_sold", cost).withColumn("realized", F.col("gross") - F.col("fee") - cost)


def reconciled(tx: DataFrame, statement: DataFrame, opening_of: Column) -> DataFrame:
    """Opening quantity and cost that make the ledger meet a statement (account_id, security_id, quantity, pool).

    coverage: full if nothing of the opening lot is left, unreconciled if a balance is negative, partial if the
    solved opening cost is not negative, else partial_uncosted.
    """
    flow = tx.groupBy(*GROUP).agg(F.sum(signed()).alias("change"))
    d = tx.join(statement.select(*GROUP, F.col("quantity").alias("s_quantity"), F.col("pool").alias("s_pool")), GROUP)
    p = pooled(d, 0, F.lit(0.0)) if opening_of is None else pooled(d, opening_of, F.lit(0.0))
    last = p.groupBy(*GROUP).agg(F.max_by(F.struct("s_quantity", "s_pool", "pool_a", "pool_b", "negative"), F.struct(*ORDER)).alias("x"))
    end = last.select(*GROUP, "x.*").join(flow, GROUP)
    q0 = F.col("s_quantity") - F.col("change")
    c0 = F.try_divide(F.col("s_pool") - F.col("pool_a"), F.col("pool_b"))
    coverage = F.when(F.col("negative"), "unreconciled").when(F.col("pool_b") == 0, "full").when(c0 >= 0, "partial").otherwise("partial_uncosted")
    return end.select(*GROUP, q0.alias("opening_quantity"), half_up(c0, 0).alias("opening_cost"), coverage.alias("coverage"), half_up(F.col("pool_b"), 6).alias("opening_share_left"))


def occurrence(tx: DataFrame, content: list[str]) -> DataFrame:
    """Number of a row among the rows with equal content, from 0: equal trades stay apart, re-imports don't."""
    return tx.withColumn("occurrence", F.row_number().over(Window.partitionBy(*content).orderBy(*ORDER)) - 1)
