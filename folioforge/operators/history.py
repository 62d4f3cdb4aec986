"""What positions were worth on every day: quantities of lots and of traced paths, prices and rates as of the day, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .paths import path_days
from .replay import POSITION
from .routes import BASE_CURRENCY
from .series import on_calendar, span_days, spans

#: Days back for the price of a trade that has none.
FILL_DAYS = 7


def lot_days(snapshots: DataFrame, start: str, end: str, paths: DataFrame | None = None, ledger_only: bool = False) -> DataFrame:
    """account_id, security_id, day, quantity, avg_cost, reported, backfilled: what each lot held on each day.

    snapshots: POSITION, lot_seq, as_of_date, quantity, avg_cost, reported. Before its first statement a lot holds what that one says
    (backfilled), unless a path says what the position held: then one lot stands for it, with the first
    statements' mean cost (if all are known) and their reported values in proportion. ledger_only: positions without a statement count by
    their path. Days with nothing held have no row.
    """
    keys = [*POSITION, "lot_seq"]
    columns = [*POSITION, "day", "quantity", "avg_cost", "reported", "backfilled"]
    q = F.col("quantity").cast("double").alias("quantity")
    s = snapshots.select(*keys, "as_of_date", q, F.col("avg_cost").cast("double").alias("avg_cost"), F.col("reported").cast("double").alias("reported"))
    held = spans(s, keys, "as_of_date", start, end).where("quantity <> 0")
    if paths is None:
        return span_days(held, "as_of_date").select(columns)
    # joins meet spans, days are made last
    known = paths.where("changes is not null")
    held = held.join(known.select(*POSITION, F.lit(True).alias("_traced")), POSITION, "left")
    days = span_days(held, "as_of_date").where(~F.col("backfilled") | F.col("_traced").isNull())
    first = s.groupBy(*keys).agg(F.min_by(F.struct("quantity", "avg_cost", "reported"), "as_of_date").alias("f"))
    whole = lambda c: F.when(F.count(c) == F.count("*"), F.sum(c))
    shape = first.select(*POSITION, "f.*").groupBy(*POSITION).agg(F.sum("quantity").alias("held"), whole(F.col("quantity") * F.col("avg_cost")).alias("cost"), whole(F.col("reported")).alias("said"))
    known = known.join(shape, POSITION, "left" if ledger_only else "inner")
    then = path_days(known, start, end, ("held", "cost", "said")).where("quantity <> 0")
    some = F.col("held") != 0
    virtual = then.select(*POSITION, "day", "quantity", F.when(some, F.col("cost") / F.col("held")).alias("avg_cost"), F.when(some, F.col("said") * F.col("quantity") / F.col("held")).alias("reported"), F.col("estimated").alias("backfilled"))
    return days.select(columns).unionByName(virtual.select(columns))


def worth(lots: DataFrame, instruments: DataFrame, prices: DataFrame, rates: DataFrame, start: str, end: str, ratios: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """lots (see lot_days) with value and cost in the base currency.

    instruments: security_id, asset_class, currency, divisor, linked; prices: security_id, date, price, price_currency; rates:
    currency, date, rate. Both count from the day on, before the first the first. Value: cash at its currency's rate, else as reported; others at
    price (a linked pension of at most one unit has none) and its currency's rate, else as reported, a point for one, else
    0. Cost: quantity x average / divisor at the security's currency; a pension's average is its total; cash has none. ratios: security_id, ratio;
    what is not there doesn't count. overrides: POSITION, override replaces the average.
    """
    # a row for each security, with its prices by the day: lots, a row for each day, meet everything of their security at once
    p = spans(prices.select("security_id", "date", F.col("price").cast("double").alias("price"), "price_currency"), ["security_id"], "date", start, end)
    p = p.groupBy("security_id").agg(F.sort_array(F.collect_list(F.struct("_from", F.sequence("_from", "_to").alias("on"), "price", "price_currency"))).alias("x"))
    p = p.select("security_id", F.flatten(F.transform("x", lambda x: F.array_repeat(F.struct(x["price"].alias("price"), x["price_currency"].alias("price_currency")), F.size(x["on"])))).alias("_daily"))
    r = on_calendar(rates.where(F.col("currency") != BASE_CURRENCY).select("currency", "date", "rate"), ["currency"], "date", start, end).select(F.col("currency").alias("_c"), F.col("day").alias("_d"), F.col("rate").cast("double").alias("_r"))
    at = F.datediff("day", F.lit(start).cast("date"))
    d = lots.join(instruments.join(p, "security_id", "left"), "security_id").withColumn("_p", F.get("_daily", F.when(at >= 0, at))).drop("_daily")
    d = d.withColumns({"price": F.col("_p.price"), "price_currency": F.col("_p.price_currency")}).drop("_p")
    if ratios is not None:
        d = d.join(ratios.select("security_id", "ratio"), "security_id").where("ratio <> 0")
    d = d if ratios is not None else d.withColumn("ratio", F.lit(1.0))
    d = d.join(overrides.select(*POSITION, "override"), POSITION, "left") if overrides is not None else d.withColumn("override", F.lit(None).cast("double"))

    def rated(d: DataFrame, currency: str, name: str) -> DataFrame:
        # rates are a row for each currency and day; the base currency's rows, which are many, meet none: their key is null
        key = F.when(F.col(currency) != BASE_CURRENCY, F.col(currency))
        d = d.withColumn("_k", key).join(F.broadcast(r), (F.col("_k") == F.col("_c")) & (F.col("day") == F.col("_d")), "left")
        return d.withColumn(name, F.when(F.col(currency) == BASE_CURRENCY, 1.0).otherwise(F.col("_r"))).drop("_k", "_c", "_d", "_r")

    d = rated(rated(d, "currency", "_own"), "price_currency", "_at")
    kind, q = F.col("asset_class"), F.col("quantity")
    guard = (kind == "pension") & F.coalesce("linked", F.lit(False)) & (q <= 1)
    priced = F.when(~guard, q * F.col("price") / F.col("divisor") * F.col("_at"))
    other = F.coalesce("reported", F.when(kind == "point", q), F.lit(0.0))
    value = F.when(kind == "cash", F.coalesce(q * F.col("_own"), "reported", F.lit(0.0))).otherwise(F.coalesce(priced, other))
    avg = F.coalesce("override", "avg_cost")
    cost = F.when(kind != "cash", F.when(kind == "pension", avg).otherwise(q * avg / F.col("divisor") * F.col("_own")))
    return d.withColumns({"value": value * F.col("ratio"), "cost": cost * F.col("ratio")}).drop("_own", "_at")


def daily(worths: DataFrame, by: list[str], display: DataFrame | None = None) -> DataFrame:
    """by, day, value, cost, quantity, backfilled of worths; cost is null where no lot has one. display: day, rate of a currency that
    money is shown in. Quantities add up only within one security."""
    d = worths.groupBy(*by, "day").agg(F.sum("value").alias("value"), F.sum("cost").alias("cost"), F.sum("quantity").alias("quantity"), F.max("backfilled").alias("backfilled"))
    if display is None:
        return d
    d = d.join(display.select("day", F.col("rate").alias("_rate")), "day", "left").withColumn("_rate", F.when(F.col("_rate") != 0, F.col("_rate")).otherwise(1.0))
    return d.withColumns({"value": F.col("value") / F.col("_rate"), "cost": F.col("cost") / F.col("_rate")}).drop("_rate")


def price_chain(linked: DataFrame, manual: DataFrame, derived: DataFrame, reported: DataFrame) -> DataFrame:
    """security_id, date, price, price_currency, source: the series that a security is valued by.

    The linked series, with manual rows over it; without one the days derived from manual appraisals; without those what
    statements reported, which is in the base currency. All: security_id, date, price, currency.
    """
    named = lambda d, source, rank: d.select("security_id", "date", F.col("price").cast("double").alias("price"), "currency", F.lit(source).alias("source"), F.lit(rank).alias("_rank"))
    has = lambda d: d.select("security_id").distinct()
    some = linked.select("security_id").unionByName(manual.select("security_id")).distinct()
    rows = named(linked, "linked", 1).unionByName(named(manual.join(has(linked), "security_id", "left_semi"), "manual", 0)).unionByName(named(derived.join(has(linked), "security_id", "left_anti"), "derived", 1))
    rows = rows.unionByName(named(reported.join(some, "security_id", "left_anti").withColumn("currency", F.lit(BASE_CURRENCY)), "reported", 1))
    best = rows.groupBy("security_id", "date").agg(F.min_by(F.struct("price", "source"), "_rank").alias("x"))
    # a series is in the currency of the rows that it was chosen for, whatever a manual row over it says
    currency = rows.groupBy("security_id").agg(F.max_by("currency", F.struct("_rank", "date")).alias("price_currency"))
    return best.join(currency, "security_id").select("security_id", "date", "x.price", "price_currency", "x.source")


def trade_prices(trades: DataFrame, series: DataFrame, days: int = FILL_DAYS) -> DataFrame:
    """trades (ref, security_id, currency, trade_date, ...) with price and priced_on: the last price in the days up to the trade, if the series is in the trade's currency.

    series: security_id, date, price, price_currency. Both meet month by month.
    """
    month = lambda c: F.trunc(c, "MM")
    t = trades.select("ref", "security_id", "currency", "trade_date").withColumn("_m", F.explode(F.sequence(month(F.date_sub("trade_date", days)), month("trade_date"), F.expr("interval 1 month"))))
    s = series.select("security_id", F.col("date").alias("_date"), F.col("price").alias("_price"), "price_currency", month("date").alias("_m"))
    near = t.join(s, ["security_id", "_m"]).where((F.col("_date") <= F.col("trade_date")) & (F.col("_date") >= F.date_sub("trade_date", days)) & (F.col("price_currency") == F.col("currency")))
    found = near.groupBy("ref").agg(F.max(F.struct("_date", "_price")).alias("_x"))
    return trades.join(found, "ref", "left").select(*trades.columns, F.col("_x._price").alias("price"), F.col("_x._date").alias("priced_on"))


def coin_rows(assets: DataFrame) -> DataFrame:
    """symbol, quantity, price, value, prev_value, day_change, day_change_pct, as_of of coins that another service reports.

    assets: asset, balance, price, value, has_price, prev_value, prev_date, all as text but has_price. Coins without a
    symbol or a readable balance, and those without a price, are left out; what else can't be read is null.
    """
    number = lambda c: F.expr(f"try_cast(trim({c}) AS decimal(38, 10))")
    d = assets.select(F.trim("asset").alias("symbol"), number("balance").alias("quantity"), number("price").alias("price"), number("value").alias("value"), number("prev_value").alias("prev_value"), "has_price", "prev_date")
    d = d.where("symbol <> '' and quantity is not null and has_price and value is not null").withColumn("day_change", F.col("value") - F.col("prev_value"))
    pct = F.try_divide(F.col("day_change").cast("double") * 100, F.col("prev_value").cast("double"))
    return d.withColumns({"day_change_pct": pct, "as_of": F.when(F.col("day_change").isNotNull(), F.col("prev_date"))}).drop("has_price", "prev_date")


def coin_points(answers: DataFrame) -> DataFrame:
    """symbol, kind (value, quantity, price), t, amount: the points of each coin's answers, all coins in one long table.

    answers: symbol, metric (which series the service says it is; null: an old one, which answers values only), t, value, balance, price. Quantities are
    the balances of the balance series, which knows days without a price; coins without that series have those beside
    their values. Prices come from the price series alone. Points without an amount are left out, not zero.
    """
    by = F.coalesce("metric", F.lit("value"))
    kind = lambda name, column: answers.select("symbol", "t", F.lit(name).alias("kind"), F.col(column).cast("double").alias("amount"), by.alias("_m"))
    exact = answers.where("metric = 'balance'").select("symbol").distinct()
    held = kind("quantity", "balance")
    rows = kind("value", "value").where("_m = 'value'").unionByName(held.where("_m = 'balance'")).unionByName(held.where("_m = 'value'").join(exact, "symbol", "left_anti")).unionByName(kind("price", "price").where("_m = 'price'"))
    return rows.where("t is not null and amount is not null").select("symbol", "kind", "t", "amount")


def coin_previous(points: DataFrame, today: str, days: int = 7) -> DataFrame:
    """symbol, prev_value: the last readable point (symbol, t, value as text) before today, if it is at most `days` old."""
    p = points.select("symbol", F.try_to_date("t").alias("day"), F.expr("try_cast(trim(value) AS decimal(38, 10))").alias("v")).where(F.col("v").isNotNull() & (F.col("day") < F.lit(today).cast("date")))
    last = p.groupBy("symbol").agg(F.max(F.struct("day", "v")).alias("x"))
    return last.where(F.datediff(F.lit(today).cast("date"), "x.day") <= days).select("symbol", F.col("x.v").alias("prev_value"))


def coin_totals(rows: DataFrame) -> DataFrame:
    """One row: value, prev_value and day_change over the coins that have one (null if none has), and partial: some coins lack it."""
    known = F.col("day_change").isNotNull() & F.col("prev_value").isNotNull()
    some = F.count_if(known) > 0
    return rows.agg(F.sum("value").alias("value"), F.sum(F.when(known, F.col("prev_value"))).alias("prev_value"), F.sum(F.when(known, F.col("day_change"))).alias("day_change"), (some & (F.count_if(~known) > 0)).alias("partial"), F.count("*").alias("coins"))


def with_coins(classes: DataFrame, coins: DataFrame, in_total: bool, name: str = "crypto") -> DataFrame:
    """Classes (asset_class, value, prev_value, day_change, partial, holdings, in_total) with the coins' totals (see coin_totals) in theirs, and weight: the share in per cent of what counts.

    The class is added if it is missing. Without a day change of the coins theirs is partial and their previous value counts for nothing.
    """
    c = coins.where("coins > 0").select(F.lit(name).alias("asset_class"), "value", "prev_value", "day_change", F.col("partial") | F.col("day_change").isNull(), F.col("coins").alias("holdings"), F.lit(in_total).alias("in_total")).toDF("asset_class", "value", "prev_value", "day_change", "partial", "holdings", "in_total")
    g = classes.select(c.columns).unionByName(c).groupBy("asset_class").agg(F.sum("value").alias("value"), F.sum("prev_value").alias("prev_value"), F.sum("day_change").alias("day_change"), F.max("partial").alias("partial"), F.sum("holdings").alias("holdings"), F.max("in_total").alias("in_total"))
    total = F.sum(F.when(F.col("in_total"), F.col("value"))).over(Window.partitionBy())  # a row for each class
    return g.withColumn("weight", F.when(F.col("in_total"), F.try_divide(F.col("value").cast("double") * 100, total.cast("double"))))
