"""The portfolio domain as DataFrames over the star-schema tables: ledger, snapshots, prices, holdings.

Money is in whole cents (long), so that sums are exact; ratios are rounded half up at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import written

OPENING = 1_000
#: Order of a ledger: the two keys alone are not unique.
ORDER = ["trade_date", "l_orderkey", "l_linenumber", "l_partkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(x: Column) -> Column:
    return F.floor(x * 100 + 0.5).cast("long")


def half_up(x: Column, digits: int = 4) -> Column:
    scale = 10.0**digits
    y = x.cast("double") * scale + 0.5
    # floor() of a double is a long: what is beyond has no fraction, and stays as it is
    return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y) / scale


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per line item; the account is the customer's nation, the security the supplier."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    kind = F.when(F.col("l_returnflag") == "N", "buy").when(F.col("l_returnflag") == "A", "reinvest").otherwise("sell")
    # orders meet customers first, so that line items, which are many and wide, are shuffled once
    j = li.join(o.join(c, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(
        F.col("c_nationkey").cast("long").alias("account_id"), F.col("l_suppkey").alias("security_id"), F.to_date("o_orderdate").alias("trade_date"), F.to_date("l_shipdate").alias("settle_date"),
        kind.alias("tx_type"), F.col("l_quantity").cast("long").alias("quantity"), cents(F.col("l_extendedprice")).alias("gross"), cents(F.col("l_extendedprice") * F.col("l_discount")).alias("fee"),
        cents(F.col("l_extendedprice") * F.col("l_tax")).alias("tax"), "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey",
    )


def exact_sum(x: Column) -> Column:
    """A sum of doubles that doesn't depend on their order: added as decimals, rounded once."""
    return F.sum(x.cast("decimal(38, 12)")).cast("double")


def stored_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger written once, for queries that go through it several times."""
    return written(ledger(spark, sf_dir), "ledger")


def stored_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a position did in each month, written once: both its snapshots and its security's prices come from it."""
    return written(months(ledger(spark, sf_dir)), "months")


def signed(quantity: str = "quantity", kind: str = "tx_type") -> Column:
    return F.when(F.col(kind) == "sell", -F.col(quantity)).otherwise(F.col(quantity))


def snapshots(tx: DataFrame) -> DataFrame:
    """Month-end positions: account_id, security_id, as_of_date, quantity, cost (of all purchases so far), bought."""
    return month_snapshots(months(tx))


def months(tx: DataFrame) -> DataFrame:
    """account_id, security_id, as_of_date (a month's end), dq, dc, db (changes of quantity, cost and bought), gross, traded."""
    buy = F.col("tx_type") != "sell"
    return tx.groupBy("account_id", "security_id", F.last_day("trade_date").alias("as_of_date")).agg(
        F.sum(signed()).alias("dq"), F.sum(F.when(buy, F.col("gross")).otherwise(0)).alias("dc"), F.sum(F.when(buy, F.col("quantity")).otherwise(0)).alias("db"), F.sum("gross").alias("gross"), F.sum("quantity").alias("traded")
    )


def month_snapshots(m: DataFrame) -> DataFrame:
    """snapshots() of months()."""
    w = Window.partitionBy("account_id", "security_id").orderBy("as_of_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return m.select("account_id", "security_id", "as_of_date", (F.sum("dq").over(w) + OPENING).alias("quantity"), F.sum("dc").over(w).alias("cost"), F.sum("db").over(w).alias("bought"))


def prices(tx: DataFrame) -> DataFrame:
    """Month-end price series of a security in cents: security_id, date, price."""
    return tx.groupBy("security_id", F.last_day("trade_date").alias("date")).agg(F.expr("sum(gross) div sum(quantity)").alias("price"))


def month_prices(m: DataFrame) -> DataFrame:
    """prices() of months()."""
    return m.groupBy("security_id", F.col("as_of_date").alias("date")).agg(F.expr("sum(gross) div sum(traded)").alias("price"))


def closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last tick of each day: event_type, date, price."""
    e = table(spark, sf_dir, "events").select("event_type", "ts", "value", "event_id")
    return e.groupBy("event_type", F.to_date("ts").alias("date")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("price"))


def securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """security_id, name, asset_class and currency of a supplier; the nation stands for the class, its region for the currency."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    n = table(spark, sf_dir, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").alias("security_id"), F.col("s_name").alias("name"), F.col("n_name").alias("asset_class"), F.col("n_regionkey").cast("long").alias("region_id"))
