"""Queries of ledgers against statements: replay, paths of quantities, transfers between accounts. Over whole tables.

What the star schema doesn't have (statement costs, several lots, foreign trades) is derived from its keys, as text
that both Spark and the SQL of the tests read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import allocation, asof, history, paths, replay, routes, series, steps, transfers
from ..sources import domain as dm
from ..sources.domain import half_up
from ..sources.scratch import written
from .queries import AS_OF, GROUP
from .wealth import RICH, _instruments, _rates, _rich, _routed

QUERIES: dict = {}

#: Statement facts of a position, from its latest snapshot (cost, bought) and the net of its trades without splits.
ANCHOR = {
    "quantity": "CASE WHEN (account_id + 3 * security_id) % 4 = 0 AND net > 0 THEN CAST(net AS DOUBLE) ELSE CAST(s_quantity AS DOUBLE) END",
    "avg_cost": "CASE WHEN (account_id + security_id) % 6 <> 0 AND bought > 0 THEN CAST(floor(s_cost / bought) AS DOUBLE) END",
    "currency": f"CASE WHEN (account_id + security_id) % 17 = 0 THEN 'GBP' ELSE {RICH['currency']} END",
    "lots": "CASE WHEN (account_id + security_id) % 9 = 0 THEN 2 ELSE 1 END",
    "acquired_on": "CASE WHEN (account_id * security_id) % 2 = 0 THEN DATE '1991-05-01' END",
}
CLOSED = "security_id % 11 = 0"


def query(f):
    QUERIES[f.__name__] = f
    return f


def _anchors(spark: SparkSession, sf: str, ledger: DataFrame) -> DataFrame:
    tx = _rich(spark, sf, ledger)
    net = tx.where((F.col("kind") != "split") & (F.col("trade_date") <= F.lit(AS_OF).cast("date"))).groupBy(*GROUP).agg(F.sum(steps.quantity_step()["delta"]).alias("net"))
    s = asof.latest_per_key(dm.snapshots(ledger), GROUP, "as_of_date", F.lit(AS_OF).cast("date"))
    s = s.where(f"NOT {CLOSED}").select(*GROUP, "as_of_date", F.col("quantity").alias("s_quantity"), F.col("cost").alias("s_cost"), "bought")
    return s.join(net, GROUP, "left").select(*GROUP, "as_of_date", *[F.expr(x).alias(k) for k, x in ANCHOR.items()])


def _replayed(spark: SparkSession, sf: str, ledger: DataFrame) -> DataFrame:
    return replay.reconciled_positions(_rich(spark, sf, ledger), _anchors(spark, sf, ledger), dm.ORDER)


@query
def position_replay(spark, sf):
    """Every position's coverage, opening lot, realised result and costs, from transactions of all types."""
    d = _replayed(spark, sf, dm.stored_ledger(spark, sf))
    digits = {"opening_quantity": 4, "opening_cost": 2, "residual_quantity": 4, "covered_quantity": 4, "avg_cost": 2, "realized": 2, "cost_sold": 2, "income": 0, "withheld": 0}
    return d.select(*[half_up(F.col(c), digits[c]).alias(c) if c in digits else F.col(c) for c in d.columns])


@query
def cost_override(spark, sf):
    """A recomputed average cost replaces a lot's own where the ledger covers the whole position, it is a single lot and the cost is known."""
    ledger = dm.stored_ledger(spark, sf)
    over = _replayed(spark, sf, ledger).where("applies").select(*GROUP, F.col("avg_cost").alias("override"))
    d = _routed(spark, sf, ledger).join(over, GROUP, "left")
    return d.select(*GROUP, F.col("override").isNotNull().alias("overridden"), half_up(routes.lot_cost(override="override"), 2).alias("lot_cost"))


#: Statements of lots, from month-end snapshots: positions start on different days, some lots later, some too low; some have none.
LOT_FROM = "CASE (account_id + security_id) % 3 WHEN 0 THEN DATE '1995-06-30' WHEN 1 THEN DATE '1996-06-30' ELSE DATE '1997-06-30' END"
LOT_QUANTITY = "CASE WHEN (account_id + 2 * security_id) % 7 = 0 THEN quantity - 960 ELSE quantity END"
LATER_LOT = "(account_id + security_id) % 9 = 0 AND as_of_date >= CASE WHEN account_id % 2 = 0 THEN DATE '1997-09-01' ELSE DATE '1995-01-01' END"
REF = "concat(l_orderkey, '-', l_linenumber, '-', l_partkey)"


def _lot_statements(spark: SparkSession, sf: str, ledger: DataFrame | None = None) -> DataFrame:
    s = dm.snapshots(ledger or dm.ledger(spark, sf)).where(f"NOT {CLOSED} AND as_of_date >= {LOT_FROM}")
    one = s.select(*GROUP, F.lit(0).alias("lot_seq"), "as_of_date", F.expr(LOT_QUANTITY).alias("quantity"))
    return one.unionByName(s.where(LATER_LOT).select(*GROUP, F.lit(1).alias("lot_seq"), "as_of_date", F.lit(10).cast("long").alias("quantity")))


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    ledger = dm.stored_ledger(spark, sf)
    return paths.quantity_paths(_rich(spark, sf, ledger).withColumn("ref", F.expr(REF)), written(_lot_statements(spark, sf, ledger), "statements"), dm.ORDER)


@query
def quantity_paths(spark, sf):
    """What every position held before its first statement, a row for each change, or why that is unknown."""
    p = _paths(spark, sf)
    return p.select(*GROUP, "status", "before", half_up(F.col("opening"), 4).alias("opening"), F.explode_outer("changes").alias("c")).select(*GROUP, "status", "before", "opening", F.col("c.day").alias("day"), half_up(F.col("c.quantity"), 4).alias("quantity"))


@query
def path_days(spark, sf):
    """Quantities of every security on each day of a quarter before statements start, and how much of it is an estimate."""
    d = paths.path_days(_paths(spark, sf), "1996-01-01", "1996-03-31")
    return d.groupBy("security_id", "day").agg(half_up(F.sum("quantity"), 2).alias("quantity"), half_up(F.sum(F.when(F.col("estimated"), F.col("quantity")).otherwise(0.0)), 2).alias("estimated"), F.count("*").alias("positions"))


#: Transfers of customers' positions: a departure for every eighth part, and how the security appears elsewhere.
DEPARTS = "l_partkey % 8 = 0"
ARRIVES = "CASE l_linenumber % 5 WHEN 0 THEN 'nowhere' WHEN 1 THEN 'ledger' WHEN 2 THEN 'statement' WHEN 3 THEN 'back' ELSE 'other quantity' END"
MOVED = {"account_id": "l_orderkey % 5000", "other": "(l_orderkey + 1 + l_partkey % 50) % 5000"}
TRADE = ["account_id", "security_id", "trade_date", "settle_date", "kind", "quantity", "unit_price", "split_ratio", "ref"]


def _moves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(trades, statements) of accounts by order: purchases and sales, and transfers with their arrivals as ARRIVES says."""
    # seven branches, which a resolution goes through again and again: what they have in common is written once
    d = dm.ledger(spark, sf).where(f"{DEPARTS} OR l_partkey % 5 = 0 OR l_partkey % 32 = 4").withColumn("price", F.floor(F.col("gross") / F.col("quantity"))).select("account_id", "security_id", "trade_date", "tx_type", "quantity", "price", "l_orderkey", "l_linenumber", "l_partkey")
    d = written(d, "moved").withColumn("ref", F.expr(REF)).withColumns({k: F.expr(x) for k, x in MOVED.items()}).withColumn("way", F.expr(ARRIVES))
    row = lambda d, account, day, kind, quantity, tag: d.select(
        F.col(account).cast("long").alias("account_id"), "security_id", day.alias("trade_date"), F.date_add(day, 2).alias("settle_date"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"),
        quantity.cast("double").alias("quantity"), F.col("price").cast("double").alias("unit_price"), F.lit(None).cast("double").alias("split_ratio"), F.concat("ref", F.lit(tag)).alias("ref"))
    day, q = F.col("trade_date"), F.col("quantity")
    out = d.where(DEPARTS)
    plain = row(d.where(f"NOT {DEPARTS} AND l_partkey % 5 = 0"), "account_id", day, F.when(F.col("tx_type") == "sell", "sell").otherwise("buy"), q, "")
    gone = row(out, "account_id", day, "transfer_out", q, "-out")
    came = row(out.where("way = 'ledger'"), "other", F.date_add(day, (F.col("l_partkey") % 40).cast("int")), "transfer_in", q, "-in")
    back = row(out.where("way = 'back'"), "account_id", F.date_add(day, (F.col("l_partkey") % 14).cast("int")), "transfer_in", q - 1, "-in")
    more = row(out.where("way = 'other quantity'"), "other", F.date_add(day, 3), "transfer_in", q + 1, "-in")
    stated = out.where("way = 'statement'").select(F.col("other").cast("long").alias("account_id"), "security_id", F.lit(0).alias("lot_seq"), F.date_add(day, (F.col("l_partkey") % 500).cast("int")).alias("as_of_date"), q.cast("double").alias("quantity"), F.col("price").cast("double").alias("avg_cost"))
    fell = d.where("l_partkey % 32 = 4").select(F.col("account_id").cast("long").alias("account_id"), "security_id", F.lit(0).alias("lot_seq"), F.explode(F.array(F.struct(day.alias("as_of_date"), q.cast("double").alias("quantity")), F.struct(F.date_add(day, 30).alias("as_of_date"), F.lit(0.0).alias("quantity")))).alias("x"), F.col("price").cast("double").alias("avg_cost"))
    moved = stated.unionByName(fell.select("account_id", "security_id", "lot_seq", "x.as_of_date", "x.quantity", "avg_cost"))
    statements = moved.groupBy(*GROUP, "lot_seq", "as_of_date").agg(F.max("quantity").alias("quantity"), F.max("avg_cost").alias("avg_cost"))
    return plain.unionByName(gone).unionByName(came).unionByName(back).unionByName(more), statements


@query
def ledger_departures(spark, sf):
    """What transfers out of an account leave after transfers in of the days about them."""
    d = transfers.ledger_departures(_moves(spark, sf)[0], ["trade_date", "ref"])
    return d.select("security_id", "account_id", "date", "quantity", half_up(F.col("cost"), 2).alias("cost"), "closed")


@query
def snapshot_outflows(spark, sf):
    """Positions whose statements fall to nothing without a sale or transfer out since the statement before."""
    tx, statements = _moves(spark, sf)
    return transfers.snapshot_departures(statements, tx).drop("source", "closed")


@query
def transfer_resolution(spark, sf):
    """Every departure's outcome: the account that it went to, or that it has to be asked about; some are decided by hand."""
    tx, statements = _moves(spark, sf)
    sure = tx.where("kind = 'transfer_out' and security_id % 25 = 0").groupBy("security_id", F.col("account_id").alias("from_account"), F.col("trade_date").alias("date")).agg(F.sum("quantity").alias("quantity"))
    manual = sure.select("security_id", "from_account", F.expr("CASE WHEN from_account % 2 = 0 THEN (from_account + 1) % 5000 END").alias("to_account"), "date", "quantity")
    return transfers.resolved(tx, statements, ["trade_date", "ref"], manual).withColumn("absorbed", F.array_join("absorbed", ","))


LOT_COST = "CASE WHEN (account_id + security_id) % 4 <> 0 THEN CAST(floor(cost / greatest(bought, 1)) AS DOUBLE) END"
LOT_REPORTED = "CASE WHEN (account_id + security_id) % 3 = 0 THEN quantity * 100.0 END"
FROM, TO = "1996-06-01", "1996-07-10"
#: Halves are rounded up whatever the order in which doubles are added.
SURE = 1 + 1e-12


def _valued_lots(spark: SparkSession, sf: str, ledger: DataFrame) -> DataFrame:
    """Statements of single lots with costs and reported values; positions start on different days, some have none."""
    s = dm.snapshots(ledger).where(f"NOT {CLOSED} AND as_of_date >= {LOT_FROM}")
    return s.select(*GROUP, F.lit(0).alias("lot_seq"), "as_of_date", F.expr(LOT_QUANTITY).alias("quantity"), F.expr(LOT_COST).alias("avg_cost"), F.expr(LOT_REPORTED).alias("reported"))


#: Securities with a linked series, and those that are appraised at a quarter's end.
LINKED = "security_id % 7 <> 3 AND security_id % 7 <> 4 AND security_id % 13 <> 5"
APPRAISED = "(security_id % 7 = 3 OR security_id % 5 = 2) AND month(date) % 3 = 0"


def _sources(spark: SparkSession, sf: str, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prices, linked, manual): all month-end prices, which statements report too, linked series and appraisals."""
    p = written(dm.prices(ledger or dm.ledger(spark, sf)), "prices").withColumn("currency", F.expr(RICH["currency"]))
    return p, p.where(LINKED), p.where(APPRAISED).withColumn("price", F.col("price") + 7)


def _chain(spark: SparkSession, sf: str, ledger: DataFrame | None = None) -> DataFrame:
    """A price series for each security: linked, manual over it, derived for 1996 from appraisals, or reported; what histories and price fills look at."""
    p, linked, manual = _sources(spark, sf, ledger)
    index = series.on_calendar(manual.where("security_id % 7 = 3").select("security_id", "date", "price", "currency"), ["security_id"], "date", "1996-01-01", "1996-12-31")
    derived = index.select("security_id", F.col("day").alias("date"), F.col("price"), "currency").where("NOT backfilled")
    reported = p.where("security_id % 13 <> 5 AND day(date) <> 31").withColumn("price", F.col("price") * 2)
    return history.price_chain(linked, manual, derived, reported)


def _whole_chain(spark: SparkSession, sf: str) -> DataFrame:
    """The price series of each security over all days: appraisals of every security that isn't linked hold from the first one to the last day of prices."""
    p, linked, manual = _sources(spark, sf)
    d = history.price_chain(linked, manual, manual, p.withColumn("price", F.col("price") * 2))
    # days, which are many, are made last
    d = d.crossJoin(F.broadcast(p.agg(F.max("date").alias("_last"))))
    following = F.lead("date").over(Window.partitionBy("security_id").orderBy("date"))
    days = F.when(F.col("source") == "derived", F.sequence("date", F.coalesce(F.date_sub(following, 1), "_last"))).otherwise(F.array("date"))
    return d.withColumn("_days", days).select("security_id", F.explode("_days").alias("date"), "price", "price_currency", "source")


def _history(spark: SparkSession, sf: str, ledger_only: bool, overrides: bool = False) -> DataFrame:
    ledger = dm.stored_ledger(spark, sf)
    tx, lots = _rich(spark, sf, ledger).withColumn("ref", F.expr(REF)), written(_valued_lots(spark, sf, ledger), "lots")
    p = paths.quantity_paths(tx, lots, dm.ORDER)
    days = history.lot_days(lots, FROM, TO, p, ledger_only)
    over = _replayed(spark, sf, ledger).where("applies").select(*GROUP, F.col("avg_cost").alias("override")) if overrides else None
    return history.worth(days, _instruments(spark, sf), _chain(spark, sf, ledger), _rates(spark, sf), FROM, TO, overrides=over)


@query
def price_chain(spark, sf):
    """The series that every security is valued by, and where it comes from."""
    return _whole_chain(spark, sf).withColumn("price", half_up(F.col("price"), 2))


@query
def history_by_class(spark, sf):
    """Daily value and cost of every class over traced and stated lots, with recomputed costs where they apply."""
    d = history.daily(_history(spark, sf, False, True), ["asset_class"])
    return d.select("asset_class", "day", half_up(F.col("value") * SURE, 0).alias("value"), half_up(F.col("cost") * SURE, 0).alias("cost"))


@query
def history_by_security(spark, sf):
    """Daily value, cost and quantity of every security, with positions that only the ledger knows, in dollars; and whether some of it is an estimate."""
    usd = series.on_calendar(_rates(spark, sf).where("currency = 'USD'"), ["currency"], "date", FROM, TO).select("day", "rate")
    d = history.daily(_history(spark, sf, True), ["security_id"], usd)
    return d.select("security_id", "day", half_up(F.col("value") * SURE, 1).alias("value"), half_up(F.col("cost") * SURE, 1).alias("cost"), half_up(F.col("quantity"), 4).alias("quantity"), "backfilled")


@query
def trade_price_fill(spark, sf):
    """Trades without a price get the last one of the seven days before, where the series is in their currency."""
    t = _rich(spark, sf).where("unit_price is null").select(F.concat_ws("-", F.expr(REF), "security_id", "quantity").alias("ref"), "security_id", "currency", "trade_date")
    return history.trade_prices(t, _chain(spark, sf)).select("ref", half_up(F.col("price"), 2).alias("price"), "priced_on")


@query
def coin_day_changes(spark, sf):
    """Coins of another service from events: what it reports today, with the previous value it gives or the last one of its own days."""
    e = dm.table(spark, sf, "events")
    day = e.groupBy("user_id", F.to_date("ts").alias("t")).agg(F.sum(F.floor(F.col("value") * 100).cast("long")).alias("v"))
    last = day.groupBy("user_id").agg(F.max_by("v", "t").alias("v"), F.count("*").alias("n"))
    text = lambda c: F.col(c).cast("string")
    assets = last.select(F.expr("CASE WHEN user_id % 17 = 0 THEN ' ' ELSE concat('C', CAST(user_id AS STRING)) END").alias("asset"), F.expr("CASE WHEN user_id % 19 = 0 THEN 'n/a' ELSE CAST(n AS STRING) END").alias("balance"), F.lit("1").alias("price"), text("v").alias("value"), F.expr("user_id % 11 <> 0").alias("has_price"), F.expr("CASE WHEN user_id % 3 = 0 THEN CAST(v - user_id AS STRING) WHEN user_id % 3 = 1 THEN 'x' END").alias("prev_value"), F.lit("2024-01-29").alias("prev_date"))
    rows = history.coin_rows(assets)
    own = history.coin_previous(day.select(F.concat(F.lit("C"), "user_id").alias("symbol"), text("t").alias("t"), text("v").alias("value")), "2024-01-30")
    d = rows.join(own.withColumnRenamed("prev_value", "own"), "symbol", "left").withColumn("previous", F.coalesce("prev_value", "own"))
    return d.select("symbol", F.col("value").cast("double").alias("value"), F.col("previous").cast("double").alias("previous"), (F.col("value") - F.col("previous")).cast("double").alias("day_change"), half_up(F.col("day_change_pct"), 4).alias("reported_pct"), "as_of")


@query
def classes_with_coins(spark, sf):
    """Classes with another service's coins in theirs: totals, day changes and shares of what counts."""
    e = dm.table(spark, sf, "events").groupBy("user_id").agg(F.sum(F.floor(F.col("value") * 100).cast("long")).alias("v"))
    rows = e.select(F.col("v").cast("decimal(38,10)").alias("value"), F.expr("CASE WHEN user_id % 3 <> 0 THEN CAST(v - user_id AS DECIMAL(38,10)) END").alias("prev_value")).withColumn("day_change", F.col("value") - F.col("prev_value"))
    c = _routed(spark, sf).groupBy("asset_class").agg(F.sum("now.value").cast("decimal(38,10)").alias("value"), F.sum("before.value").cast("decimal(38,10)").alias("prev_value"), F.lit(False).alias("partial"), F.count("*").alias("holdings"))
    c = c.withColumn("day_change", F.col("value") - F.col("prev_value")).withColumn("in_total", F.col("asset_class") != "point")
    d = history.with_coins(c, history.coin_totals(rows), True)
    return d.select("asset_class", *[half_up(F.col(x), 2).alias(x) for x in ("value", "prev_value", "day_change")], "partial", "holdings", "in_total", half_up(F.col("weight"), 5).alias("weight"))


RULES = [
    allocation.Rule("metal", (("metal", 100),), ("steel", "copper"), ("brass",)),
    allocation.Rule("large", (("size", 60), ("lost", 40)), ("large",), (), ("fund", "stock")),
    allocation.Rule("tin", (("metal", 50), ("size", 50)), ("tin", "nickel")),
    allocation.Rule("fund", (("fund", 100),), classes=("fund",)),
    allocation.Rule("guess", (("size", 100),), classes=("stock", "pension"), fallback=True),
]
CODES = {"1005": "tin", "1010": "unknown", "1015": "fund"}
PART = {"name": "concat(p_name, ' ', p_type, CASE WHEN p_partkey % 9 = 0 THEN ' ETF' ELSE '' END)", "code": "CASE WHEN p_partkey % 5 = 0 THEN CAST(1000 + p_partkey % 40 AS STRING) END", "asset_class": "CASE p_partkey % 4 WHEN 0 THEN 'fund' WHEN 1 THEN 'stock' WHEN 2 THEN 'cash' ELSE 'pension' END"}


@query
def rule_suggestions(spark, sf):
    """What rules by code, by keyword and by class suggest for every part, and what that would change."""
    p = dm.table(spark, sf, "part").select(F.col("p_partkey").alias("security_id"), *[F.expr(x).alias(k) for k, x in PART.items()])
    tags = spark.createDataFrame([(1, "metal"), (2, "size"), (3, "fund")], "tag_id long, name string")
    current = p.where("security_id % 3 <> 0").select("security_id", F.explode(F.expr("CASE WHEN security_id % 6 = 1 THEN array(1L, 2L) ELSE array(security_id % 3) END")).alias("tag_id")).withColumn("weight", F.expr("CASE WHEN security_id % 6 = 1 THEN 50 ELSE 100 END"))
    d = allocation.suggestions(allocation.matched_rules(p, RULES, CODES), RULES, tags, current)
    pairs = F.array_join(F.transform("suggested", lambda x: F.concat(x["tag_id"].cast("string"), F.lit(":"), x["weight"].cast("int").cast("string"))), ",")
    return d.select("security_id", "rule", "matched_by", "matched_value", "doubtful", "status", pairs.alias("suggested"), F.array_join("missing", ",").alias("missing"))


@query
def lot_totals(spark, sf):
    """What every position holds over all its lots on each statement day, and its mean cost, if all that is held has one."""
    s = _lot_statements(spark, sf).withColumn("avg_cost", F.expr("CASE WHEN (security_id + lot_seq + month(as_of_date)) % 5 <> 0 THEN CAST(100 + security_id + lot_seq * 50 AS DOUBLE) END"))
    d = transfers.totals(s)
    return d.select(*GROUP, "date", "total", half_up(F.col("cost"), 4).alias("cost"))


@query
def previous_day_basis(spark, sf):
    """The day that an account's day change is measured from: the one before its last statement, at most two days ago, never after yesterday."""
    today = F.lit(AS_OF).cast("date")
    last = _lot_statements(spark, sf).withColumn("as_of_date", F.date_add("as_of_date", (F.col("account_id") % 5).cast("int"))).where(F.col("as_of_date") <= F.date_add(today, 3)).groupBy("account_id").agg(F.max("as_of_date").alias("last"))
    return last.select("account_id", F.date_sub(F.greatest(F.least("last", today), F.date_sub(today, 1)), 1).alias("basis"))
