"""Routes by which a lot gets its value and its cost. Null is unknown; a value says by which route it came."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASE_CURRENCY = "JPY"


def rate_of(currency: str, rate: str) -> Column:
    """The base currency is 1, whatever the series say."""
    return F.when(F.col(currency) == BASE_CURRENCY, F.lit(1.0)).otherwise(F.col(rate))


def value_route(quantity: str = "quantity", price: str = "price", rate: str = "rate") -> Column:
    """struct(value, route) of a lot with asset_class, currency, divisor, linked, reported.

    Cash is its quantity in base currency (without a rate the reported value); a linked pension of at most one unit
    ignores its price, as its units aren't derived yet; then price, reported value, and a point for one unit of the base.
    """
    q, fx = F.col(quantity).cast("double"), rate_of("currency", rate)
    kind = F.col("asset_class")
    cash = kind == "cash"
    usable = F.when((kind == "pension") & F.col("linked") & (q <= 1), F.lit(None)).otherwise(F.col(price).cast("double"))
    priced = q * usable / F.col("divisor") * fx
    reported = F.col("reported").cast("double")
    pair = lambda v, name: F.struct(v.cast("double").alias("value"), F.lit(name).alias("route"))
    return (
        F.when(cash & fx.isNotNull(), pair(q * fx, "cash")).when(cash, pair(reported, "reported")).when(priced.isNotNull(), pair(priced, "price"))
        .when(reported.isNotNull(), pair(reported, "reported")).when(kind == "point", pair(q, "point")).otherwise(pair(F.lit(None), "none"))
    )


def has_price(route: str) -> Column:
    return F.col(f"{route}.route").isin("cash", "price")


def previous_value(now: str, before: str) -> Column:
    """The previous value, only if both days were valued by price (or cash), or both points without one."""
    point = (F.col("asset_class") == "point") & ~has_price(now)
    return F.when((has_price(now) & has_price(before)) | point, F.col(f"{before}.value"))


def lot_cost(rate: str = "rate", override: str | None = None) -> Column:
    """Quantity x average cost / divisor x rate; a pension's average cost is its total; an override replaces the average."""
    avg = F.coalesce(F.col(override), F.col("avg_cost")) if override else F.col("avg_cost")
    avg = avg.cast("double")
    return F.when(F.col("asset_class") == "pension", avg).otherwise(F.col("quantity") * avg / F.col("divisor") * rate_of("currency", rate))


def rates_as_of(lookups: DataFrame, rates: DataFrame, day: str = "day") -> DataFrame:
    """lookups (currency, day, ...) with rate: the latest up to the day, before the first the first; 1 for the base; null without a series.

    Lookups meet the rates of their currency and month, which carries the rate before it. The base currency's lookups, which are many, meet
    none: their key is null.
    """
    month = lambda c: F.trunc(c, "MM")
    w = Window.partitionBy("currency").orderBy("date")
    s = rates.select("currency", "date", F.col("rate").alias("_rate"), F.lead("date").over(w).alias("_next"), F.row_number().over(w).alias("_n"))
    span = lookups.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    s = s.join(F.broadcast(span))  # one row
    start = F.when(F.col("_n") == 1, F.least("lo", "date")).otherwise(F.col("date"))
    end = F.coalesce(F.date_sub("_next", 1), F.greatest("hi", "date"))
    s = s.withColumn("_from", start).withColumn("_to", end).where((F.col("_to") >= F.col("lo")) & (F.col("_from") <= F.col("hi")))
    s = s.withColumn("_month", F.explode(F.sequence(month(F.greatest("_from", "lo")), month(F.least("_to", "hi")), F.expr("interval 1 month"))))
    s = s.select(F.col("currency").alias("_c"), "_month", "_from", "_to", "_rate")
    foreign = F.when(F.col("currency") != BASE_CURRENCY, F.col("currency"))
    d = lookups.join(s, (foreign == F.col("_c")) & (month(F.col(day)) == F.col("_month")) & (F.col(day) >= F.col("_from")) & (F.col(day) <= F.col("_to")), "left")
    return d.select(*lookups.columns, F.when(F.col("currency") == BASE_CURRENCY, 1.0).otherwise(F.col("_rate").cast("double")).alias("rate"))
