"""Queries of valuation routes, transaction types, resolution and table rewrites, over whole tables.

The star schema has neither currencies nor all transaction types; RICH and INSTRUMENT derive them, as text that both
Spark and the SQL of the tests read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import asof, classify, routes, sinks, steps, valuation
from ..sources import domain as dm
from ..sources.domain import half_up
from .queries import AS_OF, GROUP, PREVIOUS

QUERIES: dict = {}

#: Transactions of every type, with amounts that are partly missing.
RICH = {
    "kind": "CASE l_partkey % 16 WHEN 0 THEN 'dividend' WHEN 1 THEN 'return_of_capital' WHEN 2 THEN 'split' WHEN 3 THEN 'transfer_in' WHEN 4 THEN 'transfer_out' WHEN 5 THEN 'cash_in' WHEN 6 THEN 'cash_out' WHEN 7 THEN 'other' ELSE tx_type END",
    "unit_price": "CASE WHEN l_linenumber % 5 <> 4 THEN CAST(floor(gross / quantity) AS BIGINT) END",
    "gross_amount": "CASE l_linenumber % 3 WHEN 0 THEN 0 WHEN 1 THEN gross END",
    "net_amount": "CASE WHEN l_linenumber % 3 = 0 AND l_partkey % 5 <> 0 THEN gross + fee + tax WHEN l_partkey % 7 = 0 THEN 0 END",
    "split_ratio": "CASE WHEN l_partkey % 16 = 2 AND l_orderkey % 3 <> 0 THEN CAST(l_orderkey % 3 + 1 AS DOUBLE) END",
    "divisor": "CASE WHEN security_id % 4 = 0 THEN 10000 ELSE 1 END",
    "currency": "CASE security_id % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'JPY' END",
}
INSTRUMENT = {
    "asset_class": "CASE security_id % 7 WHEN 0 THEN 'cash' WHEN 1 THEN 'pension' WHEN 2 THEN 'point' WHEN 3 THEN 'fund' ELSE 'stock' END",
    "currency": RICH["currency"],
    "divisor": RICH["divisor"],
    "linked": "security_id % 3 = 0",
    "inactive": "security_id % 19 = 0",
    "source_type": "CASE security_id % 6 WHEN 0 THEN 'manual' WHEN 1 THEN 'none' WHEN 2 THEN 'remote' ELSE 'series' END",
}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _rich(spark: SparkSession, sf: str, ledger: DataFrame | None = None) -> DataFrame:
    return (ledger or dm.ledger(spark, sf)).select("*", *[F.expr(x).alias(k) for k, x in RICH.items()])


def _instruments(spark: SparkSession, sf: str) -> DataFrame:
    s = dm.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("security_id"), F.col("s_name").alias("name"))
    return s.select("*", *[F.expr(x).alias(k) for k, x in INSTRUMENT.items()])


def _rates(spark: SparkSession, sf: str) -> DataFrame:
    """currency, date, rate: two currencies, from the monthly prices of two securities."""
    p = dm.prices(dm.ledger(spark, sf)).where("security_id in (1, 2) and month(date) % 2 = 0")
    return p.select(F.when(F.col("security_id") == 1, "USD").otherwise("EUR").alias("currency"), "date", (F.col("price") / 100000.0).alias("rate"))


def _routed(spark: SparkSession, sf: str, ledger: DataFrame | None = None) -> DataFrame:
    """Lots of AS_OF and PREVIOUS with their instrument, prices, rates, reported values, and both days' value routes."""
    tx = ledger or dm.ledger(spark, sf)
    day, prev = F.lit(AS_OF).cast("date"), F.lit(PREVIOUS).cast("date")
    s = asof.latest_at(dm.snapshots(tx), GROUP, "as_of_date", {"cur": day, "old": prev}).where("cur is not null")
    p = asof.latest_at(dm.prices(tx), ["security_id"], "date", {"now": day, "then": prev})
    r = asof.latest_at(_rates(spark, sf), ["currency"], "date", {"now": day, "then": prev})
    d = s.select(*GROUP, F.expr("CASE WHEN account_id % 6 = 1 THEN 1 ELSE cur.quantity END").alias("quantity"), F.expr("CASE WHEN account_id % 6 = 1 THEN 1 ELSE coalesce(old.quantity, cur.quantity) END").alias("prev_quantity"),
        F.expr("CASE WHEN (account_id + security_id) % 4 <> 0 THEN CAST(floor(cur.cost / greatest(cur.bought, 1)) AS BIGINT) END").alias("avg_cost"), F.expr("CASE WHEN (account_id + security_id) % 3 = 0 THEN cur.quantity * 100 END").alias("reported"))
    d = d.join(_instruments(spark, sf), "security_id").join(p.select("security_id", F.expr("CASE WHEN security_id % 10 <> 6 THEN now.price END").alias("price"), F.expr("then.price").alias("prev_price")), "security_id", "left")
    d = d.join(r.select("currency", F.col("now.rate").alias("rate"), F.col("then.rate").alias("prev_rate")), "currency", "left")
    return d.withColumn("now", routes.value_route()).withColumn("before", routes.value_route("prev_quantity", "prev_price", "prev_rate"))


@query
def lot_value_routes(spark, sf):
    return _routed(spark, sf).select(*GROUP, "asset_class", half_up(F.col("now.value"), 2).alias("value"), F.col("now.route").alias("route"), routes.has_price("now").alias("has_price"))


@query
def previous_same_route(spark, sf):
    d = _routed(spark, sf).withColumn("prev_value", routes.previous_value("now", "before"))
    return d.select(*GROUP, half_up(F.col("prev_value"), 2).alias("prev_value"), half_up(F.col("now.value") - F.col("prev_value"), 2).alias("day_change"))


@query
def lot_costs(spark, sf):
    return _routed(spark, sf).select(*GROUP, half_up(routes.lot_cost(), 2).alias("lot_cost"))


@query
def summary_display_currency(spark, sf):
    """Class totals in another currency; a null value stays unknown."""
    usd = _rates(spark, sf).where(f"currency = 'USD' and date <= date'{AS_OF}'").agg(F.max_by("rate", "date").alias("display"))
    d = _routed(spark, sf).groupBy("asset_class").agg(F.sum("now.value").alias("value"), F.count("*").alias("lots"), F.count_if(F.col("now.value").isNull()).alias("unvalued"))
    return d.join(F.broadcast(usd)).select("asset_class", half_up(F.col("value") / F.col("display"), 2).alias("value"), "lots", "unvalued")


@query
def summary_json(spark, sf):
    """Responses: decimals as text, percentages with two digits, nulls kept."""
    d = _routed(spark, sf).groupBy("asset_class").agg(dm.exact_sum(F.col("now.value")).alias("value"), dm.exact_sum(F.when(F.col("now.value").isNotNull(), routes.lot_cost())).alias("cost"))
    text = lambda c: half_up(c, 2).cast("decimal(38,2)").cast("string")
    return d.select("asset_class", text(F.col("value")).alias("value"), text(F.try_divide(F.col("value") * 100, F.col("cost"))).alias("value_to_cost_pct"))


@query
def fx_asof(spark, sf):
    look = _rich(spark, sf).select("currency", F.col("trade_date").alias("day"), "gross")
    d = routes.rates_as_of(look, _rates(spark, sf))
    return d.groupBy("currency").agg(F.count("*").alias("lookups"), F.count("rate").alias("found"), half_up(F.sum(F.col("gross") * F.col("rate")) / 1e6, 1).alias("converted"))


@query
def unpriced_and_needs_valuation(spark, sf):
    """Active securities without a price source that have a series, and those that only a person can value."""
    d = _routed(spark, sf).where(~F.col("inactive"))
    g = d.groupBy("security_id", "source_type").agg(F.bool_and(F.col("now.value").isNull()).alias("unvalued"), F.bool_or(F.col("price").isNotNull()).alias("priced"))
    which = F.when((F.col("source_type") == "series") & ~F.col("priced"), "unpriced").when(F.col("source_type").isin("manual", "none") & F.col("unvalued"), "needs_valuation")
    return g.select("security_id", which.alias("list")).where("list is not null")


@query
def source_partition(spark, sf):
    d = _instruments(spark, sf)
    part = F.when(F.col("inactive"), "skipped").when(F.col("source_type") == "manual", "manual").when(F.col("source_type") == "remote", "remote").when((F.col("source_type") == "series") & F.col("linked"), "linked").otherwise("local")
    return d.groupBy(part.alias("part"), "asset_class").agg(F.count("*").alias("n"))


@query
def estimated_flags(spark, sf):
    """Index-linked securities whose last appraisal is before the day."""
    last = _rich(spark, sf).where("kind = 'other'").groupBy("security_id").agg(F.max("trade_date").alias("appraised"))
    d = _instruments(spark, sf).where("linked").join(last, "security_id", "left")
    return d.select("security_id", "appraised", F.coalesce(F.col("appraised") < F.lit(AS_OF).cast("date"), F.lit(False)).alias("estimated"))


@query
def currency_mismatch(spark, sf):
    """Securities whose price series is in another currency than they are; the last row of a series says which it has."""
    p = _rich(spark, sf).groupBy("security_id").agg(F.max_by(F.expr("CASE WHEN l_orderkey % 9 = 0 THEN 'GBP' ELSE currency END"), F.struct(*dm.ORDER)).alias("series_currency"))
    return _instruments(spark, sf).join(p, "security_id").where("series_currency <> currency").select("security_id", "currency", "series_currency")


@query
def series_range(spark, sf):
    """Rows of a series between two days, both included, with the currency of the series' last row."""
    p = dm.prices(dm.ledger(spark, sf)).where("date between date'1997-03-31' and date'1997-09-30'")
    last = _rich(spark, sf).where("trade_date between date'1997-03-31' and date'1997-09-30'").groupBy("security_id").agg(F.max_by("currency", F.struct(*dm.ORDER)).alias("currency"))
    return p.join(last, "security_id", "left").groupBy("security_id", "currency").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.sum("price").alias("prices"))


@query
def security_search(spark, sf):
    """A substring of name or code (case doesn't matter), wildcards taken literally, in one class."""
    p = dm.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    hit = F.contains(F.lower("p_name"), F.lit("bolt")) | F.contains(F.lower("p_brand"), F.lit("#13"))
    return p.where(hit).groupBy("p_type").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


@query
def trade_amounts(spark, sf):
    d = _rich(spark, sf).withColumn("amount", steps.trade_amount())
    return d.groupBy("kind").agg(F.count("*").alias("n"), F.sum("amount").cast("long").alias("amount"), F.count_if(F.col("amount") == 0).alias("missing"))


@query
def acquisition_costs(spark, sf):
    d = _rich(spark, sf)
    return d.groupBy("kind", "divisor").agg(half_up(F.sum(steps.acquisition_cost()), 0).alias("cost"), half_up(F.sum(steps.proceeds()), 0).alias("proceeds"))


@query
def quantity_steps(spark, sf):
    d = _rich(spark, sf).withColumn("s", steps.quantity_step())
    return d.groupBy("kind").agg(F.count("*").alias("n"), F.count("s").alias("moving"), half_up(F.sum("s.delta"), 0).alias("delta"), half_up(F.sum("s.mult"), 2).alias("mult"))


@query
def opening_with_splits(spark, sf):
    """The opening quantity that makes the steps meet the last snapshot: q = alpha x opening + beta."""
    d = steps.composed(_rich(spark, sf), GROUP, dm.ORDER)
    s = asof.latest_per_key(dm.snapshots(dm.ledger(spark, sf)), GROUP, "as_of_date").select(*GROUP, "quantity")
    return d.join(s, GROUP).select(*GROUP, half_up(F.col("alpha"), 4).alias("alpha"), half_up(F.col("beta"), 2).alias("beta"), half_up((F.col("quantity") - F.col("beta")) / F.col("alpha"), 2).alias("opening"))


#: Split ratios as statements write them.
RATIOS = "CASE l_linenumber % 7 WHEN 0 THEN concat(CAST(l_linenumber AS STRING), ':', CAST(l_partkey % 4 AS STRING)) WHEN 1 THEN concat('1対', CAST(l_partkey % 4 + 1 AS STRING)) WHEN 2 THEN concat(' 2：', CAST(l_partkey % 5 AS STRING), ' ') WHEN 3 THEN 'none' WHEN 4 THEN concat('1/1.', CAST(l_partkey % 3 AS STRING)) WHEN 5 THEN concat(CAST(l_partkey % 4 AS STRING), '.5') ELSE concat('0:', CAST(l_partkey % 3 AS STRING)) END"


@query
def split_ratio_parse(spark, sf):
    li = dm.table(spark, sf, "lineitem").select(F.expr(RATIOS).alias("raw"))
    return li.groupBy("raw").agg(F.count("*").alias("n")).select("raw", "n", half_up(steps.split_ratio(F.col("raw")), 4).alias("ratio"))


@query
def late_trades(spark, sf):
    """Trades after their position's snapshot, left out until the next one; and trades in another currency than the security's."""
    s = asof.latest_per_key(dm.snapshots(dm.ledger(spark, sf)), GROUP, "as_of_date", F.lit(AS_OF).cast("date")).select(*GROUP, "as_of_date")
    d = _rich(spark, sf).join(s, GROUP)
    return d.groupBy(*GROUP).agg(F.count_if(F.col("trade_date") > F.col("as_of_date")).alias("after_snapshot"), F.count_if(F.col("trade_date") <= F.col("as_of_date")).alias("usable"), F.max(F.when(F.col("trade_date") <= F.col("as_of_date"), F.col("trade_date"))).alias("last_used"))


@query
def no_movement_rows(spark, sf):
    d = _rich(spark, sf).withColumn("quantity", F.expr("CASE WHEN l_orderkey % 4 = 0 THEN 0 WHEN l_orderkey % 4 = 1 THEN NULL ELSE quantity END"))
    return d.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(classify.no_movement()).alias("without_movement"))


#: Labels of every type, of additions in brackets and of margin trades.
LABELS = (
    "Buy", "買付(特定)", "SELL order", "売却", "Dividend [US]", "配当金", "分配金再投資", "入庫（移管）", "出庫", "株式分割", "分割売却", "元本払戻金", "振替入金", "出金", "(buy) fee", "", "投信（買付）", "ご入金（カード積立）", "信用新規買い", "現渡", "現引",
    "国内累投NISA払出（特定へ）", "振替（信用保証金へ）", "振替", "ポイント換金", "買取請求", "特別分配金", "募集", "利金", "口数変更", "何か",
)


@query
def tx_labels_classified(spark, sf):
    """Types from labels of several vocabularies, how sure they are, and how many rows each label has."""
    names = F.array(*[F.lit(x) for x in LABELS])
    d = dm.table(spark, sf, "lineitem").select(F.get(names, ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % (len(LABELS) + 1)).cast("int")).alias("label"))
    return d.groupBy("label").agg(F.count("*").alias("n")).withColumn("t", classify.type_of(F.col("label"))).select("label", "n", "t.kind", "t.sure")


@query
def current_quantity(spark, sf):
    """Quantity per security over the accounts' latest snapshots; sums of zero go."""
    s = asof.latest_per_key(_snapshots(spark, sf), GROUP, "as_of_date")
    return s.groupBy("security_id").agg(F.sum("quantity").alias("quantity")).where("quantity <> 0")


def _snapshots(spark, sf):
    return dm.snapshots(dm.ledger(spark, sf))


@query
def weighted_anchor_cost(spark, sf):
    """Average cost of an account's costed lots by quantity; null and flagged where costed and uncosted ones mix."""
    d = _routed(spark, sf)
    mixed = (F.count("avg_cost") > 0) & (F.count("avg_cost") < F.count("*"))
    avg = half_up(F.try_divide(F.sum(F.col("quantity") * F.col("avg_cost")).cast("double"), F.sum(F.when(F.col("avg_cost").isNotNull(), F.col("quantity"))).cast("double")), 2)
    return d.groupBy("account_id").agg(mixed.alias("mixed"), F.when(~mixed, avg).alias("avg_cost"), F.count("*").alias("lots"))


@query
def inferred_currency(spark, sf):
    """The most frequent currency of an account's trades; of equally frequent ones the first seen."""
    d = _rich(spark, sf).groupBy("account_id", "currency").agg(F.count("*").alias("n"), F.min(F.struct(*dm.ORDER)).alias("seen"))
    w = Window.partitionBy("account_id").orderBy(F.desc("n"), "seen")
    return d.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("account_id", "currency", "n")


@query
def classes_by_value(spark, sf):
    """Classes by falling value, unknown values after known ones, points (the untagged) always last."""
    g = _routed(spark, sf).groupBy("asset_class").agg(half_up(F.sum("now.value"), 2).alias("value"))
    w = Window.orderBy(F.col("asset_class") == "point", F.desc_nulls_last("value"), "asset_class")
    return g.withColumn("position", F.row_number().over(w).cast("long"))


@query
def user_sort(spark, sf):
    """A column sorted by its numbers where it has them, then by text; empty cells last in either direction."""
    c = dm.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.max(F.expr("CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE c_name END")).alias("cell"), F.max(F.expr("CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE c_acctbal END")).alias("amount"))
    empty = F.col("cell").isNull() | (F.col("cell") == "")
    up, down = Window.orderBy(empty, "cell", "c_nationkey"), Window.orderBy(empty, F.desc("cell"), "c_nationkey")
    n = Window.orderBy(F.desc_nulls_last("amount"), "c_nationkey")
    return c.select("c_nationkey", F.row_number().over(up).cast("long").alias("up"), F.row_number().over(down).cast("long").alias("down"), F.row_number().over(n).cast("long").alias("by_amount"))


@query
def portfolio_prorated(spark, sf):
    """Value, cost and the day's change of a portfolio that holds a share of each security."""
    share = F.when(F.col("security_id") % 13 == 0, 0.0).when(F.col("security_id") % 11 == 0, 1.0).otherwise(F.least((F.col("security_id") % 5) * 0.3, F.lit(1.0)))
    d = _routed(spark, sf).withColumn("prev_value", routes.previous_value("now", "before")).withColumn("share", share).where("share > 0")
    part = lambda c: half_up(F.sum(c * F.col("share")), 1)
    cost = routes.lot_cost()
    return d.groupBy("currency").agg(part(F.col("now.value")).alias("value"), part(cost).alias("cost"), part(F.when(cost.isNotNull(), F.col("now.value"))).alias("costed_value"), part(F.col("now.value") - F.col("prev_value")).alias("day_change"), F.countDistinct("security_id").alias("securities"))


@query
def range_starts(spark, sf):
    """First days of the history ranges: 7, 30, 90, 365 days, and all (five years, or since the oldest record if that is earlier)."""
    day = F.lit(AS_OF).cast("date")
    old = dm.ledger(spark, sf).groupBy("account_id").agg(F.min("trade_date").alias("oldest"))
    spans = F.explode(F.array(*[F.struct(F.lit(n).alias("range"), F.lit(k).alias("days")) for n, k in (("7d", 7), ("30d", 30), ("90d", 90), ("1y", 365), ("all", 1825))]))
    d = old.select("account_id", "oldest", spans.alias("x"))
    return d.select("account_id", F.col("x.range").alias("range"), F.when(F.col("x.range") == "all", F.least(F.date_sub(day, F.col("x.days")), "oldest")).otherwise(F.date_sub(day, F.col("x.days"))).alias("start"))


@query
def history_chunks(spark, sf):
    """Wanted intervals clamped to the day before, in pieces of at most 365 days, the last one shorter."""
    yesterday = F.date_sub(F.lit(AS_OF).cast("date"), 1)
    d = dm.ledger(spark, sf).groupBy("security_id").agg(F.min("trade_date").alias("lo"), F.least(F.max("trade_date"), yesterday).alias("hi")).where("lo <= hi")
    d = d.select("security_id", "hi", F.explode(F.sequence("lo", "hi", F.expr("interval 365 day"))).alias("start"))
    return d.select("security_id", "start", F.least(F.date_add("start", 364), "hi").alias("end"))


@query
def freshness(spark, sf):
    """Series whose last row is at most 35 days old."""
    p = dm.prices(dm.ledger(spark, sf)).where(f"date <= date'{AS_OF}' and (security_id % 4 <> 1 or date < date'1998-04-01')").groupBy("security_id").agg(F.max("date").alias("last"))
    return p.select("security_id", "last", (F.datediff(F.lit(AS_OF).cast("date"), "last") <= 35).alias("fresh"))


@query
def batch_rollback(spark, sf):
    """The ledger after batch B3 is undone; rows that an earlier or later batch also brought stay and change owner."""
    rows = dm.ledger(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "quantity").withColumns({"dedup_key": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"), "batch_id": F.concat(F.lit("B"), F.col("l_orderkey") % 6)})
    again = rows.where("l_partkey % 3 = 0").select("dedup_key", F.concat(F.lit("B"), (F.col("l_orderkey") + F.col("l_partkey")) % 6).alias("batch_id"))
    links = rows.select("dedup_key", "batch_id").unionByName(again).withColumn("seen", F.pmod(F.regexp_extract("batch_id", "[0-9]+", 0).cast("long") + 4, F.lit(6)))
    return sinks.rolled_back(rows, links, "B3").groupBy("batch_id").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))


@query
def statement_commit(spark, sf):
    """Snapshots after an account's statement is read again: its day is replaced, and missing lots are set to zero."""
    s = _snapshots(spark, sf).select(*GROUP, "as_of_date", "quantity").where("as_of_date >= date'1998-05-31'")
    day = s.where(f"as_of_date = date'{AS_OF}' and account_id % 5 = 2")
    new = day.where("security_id % 4 <> 0").withColumn("quantity", F.col("quantity") + 3)
    gone = day.where("security_id % 8 = 0").select(*GROUP)
    out = sinks.replaced_statement(s, new, "account_id", "as_of_date", gone, tuple(GROUP))
    return out.groupBy("account_id", "as_of_date").agg(F.count("*").alias("lots"), F.sum("quantity").alias("quantity"), F.count_if(F.col("quantity") == 0).alias("zeroed"))


@query
def replace_derived(spark, sf):
    tx = dm.ledger(spark, sf)
    old = tx.where("trade_date < date'1997-01-01'").groupBy(*GROUP).agg(F.count("*").alias("n")).withColumn("batch_id", F.concat(F.lit("B"), F.col("n") % 4))
    new = tx.where("trade_date >= date'1996-07-01'").groupBy(*GROUP).agg(F.count("*").alias("n")).withColumn("batch_id", F.expr("CASE WHEN n % 3 = 0 THEN 'new' END"))
    return sinks.replaced_derived(old, new, GROUP).groupBy("batch_id").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))


@query
def purge_previews(spark, sf):
    e = dm.table(spark, sf, "events").select("event_id", F.col("ts").alias("created_at"), F.expr("CASE WHEN event_type = 'purchase' THEN 'committed' ELSE 'preview' END").alias("status"))
    return sinks.purged(e, "2024-01-30 12:00:00").groupBy("status").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query
def unique_violations(spark, sf):
    p = dm.table(spark, sf, "part").select(F.expr("CASE WHEN p_size % 2 = 0 THEN p_brand END").alias("code"), "p_size", F.col("p_type").alias("status"))
    return sinks.violations(p, "code", "p_size < 30")


@query
def batch_row_counts(spark, sf):
    """Rows of a batch, counted in the table that its kind writes to."""
    tx = dm.ledger(spark, sf).groupBy("account_id").agg(F.count("*").alias("tx"))
    s = _snapshots(spark, sf).groupBy("account_id").agg(F.count("*").alias("lots"))
    b = dm.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("account_id"), F.expr("CASE n_regionkey % 2 WHEN 0 THEN 'ledger' ELSE 'statement' END").alias("kind"))
    d = b.join(tx, "account_id", "left").join(s, "account_id", "left")
    return d.select("account_id", "kind", F.coalesce(F.when(F.col("kind") == "ledger", F.col("tx")).otherwise(F.col("lots")), F.lit(0)).alias("rows"))


@query
def normalized_codes(spark, sf):
    """Five characters that end in 0 lose it; of codes that then are a digit and three digits or letters, known ones stay as they are."""
    raw = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat(lpad(CAST(p_partkey % 9000 + 1000 AS STRING), 4, '0'), '0') WHEN 1 THEN concat(CAST(p_partkey % 10 AS STRING), 'A', CAST(p_partkey % 90 + 10 AS STRING)) WHEN 2 THEN concat(' ', CAST(p_partkey % 9000 + 1000 AS STRING)) ELSE p_brand END")
    p = dm.table(spark, sf, "part").select(raw.alias("raw"))
    return p.select("raw", fx.security_code(F.col("raw")).alias("code")).groupBy("code").agg(F.count("*").alias("n"), F.min("raw").alias("first_raw"))


@query
def currency_words(spark, sf):
    words = F.array(*[F.lit(x) for x in ("円", "米ドル", "ユーロ", "USD", "us$", "€", "JPY", "£", "?", None)])
    d = dm.table(spark, sf, "customer").select(F.get(words, (F.col("c_custkey") % 10).cast("int")).alias("word"))
    return d.groupBy("word").agg(F.count("*").alias("n")).select("word", "n", fx.currency(F.col("word")).alias("currency"))


@query
def row_inclusion(spark, sf):
    """Which preview rows go in: sure enough, resolved, no cash row, no duplicate; the first reason that holds otherwise."""
    d = _rich(spark, sf).select("kind", (F.col("l_partkey") % 10 / 10.0).alias("confidence"), F.when(F.col("l_orderkey") % 7 != 0, F.col("security_id")).alias("security_id"), (F.col("l_linenumber") == 7).alias("duplicate"))
    why = F.when(F.col("confidence") < 0.7, "unsure").when(F.col("security_id").isNull(), "unresolved").when(F.col("kind").isin("cash_in", "cash_out"), "cash").when(F.col("duplicate"), "duplicate").otherwise("included")
    return d.groupBy(why.alias("decision")).agg(F.count("*").alias("n"))


@query
def header_fingerprints(spark, sf):
    """SHA-1 of a layout's sorted, normalised labels: the order of columns doesn't matter."""
    p = dm.table(spark, sf, "part").select("p_partkey", F.split("p_type", " ").alias("labels"))
    key = F.sha1(F.array_join(F.array_sort(F.transform("labels", lambda x: F.lower(F.regexp_replace(x, r"\s", "")))), "|"))
    return p.groupBy(key.alias("fingerprint")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


@query
def external_merge(spark, sf):
    """Holdings with the rows of another application: its rows have no security and count in the totals of their class."""
    own = _routed(spark, sf).groupBy("asset_class").agg(F.sum("now.value").alias("value"), F.count("*").alias("rows"))
    other = dm.table(spark, sf, "events").where("event_type in ('click', 'view')").groupBy(F.expr("CASE WHEN event_type = 'click' THEN 'coin' ELSE 'stock' END").alias("asset_class")).agg(F.sum(F.floor(F.col("value") * 100 + 0.5)).cast("double").alias("value"), F.count("*").alias("rows"))
    return own.unionByName(other).groupBy("asset_class").agg(half_up(F.sum("value"), 1).alias("value"), F.sum("rows").alias("rows"))


@query
def external_history(spark, sf):
    """Another application's history added by date: carried forward, never backward, weighted."""
    c = dm.closes(spark, sf)
    own = c.where("event_type = 'view'").select("date", F.col("price").alias("own"))
    from ..operators import series

    sparse = c.where("event_type = 'click' and dayofmonth(date) % 4 = 2")
    filled = series.on_calendar(sparse, ["event_type"], "date", "2024-01-01", "2024-01-31").where(~F.col("backfilled")).select(F.col("day").alias("date"), (F.col("price") * 0.25).alias("added"))
    d = own.join(filled, "date", "left")
    return d.select("date", half_up(F.col("own") + F.coalesce("added", F.lit(0.0)), 4).alias("value"), F.col("added").isNotNull().alias("complete"))


@query
def allocation_diff(spark, sf):
    """Suggested tags against the stored ones: new, change, unchanged, no-rule, missing-tag."""
    s = _instruments(spark, sf).select("security_id", F.expr("CASE security_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'zz' END").alias("suggested"), F.expr("CASE security_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END").alias("stored"))
    tags = spark.createDataFrame([("a", 1), ("b", 2)], "suggested string, tag_id int")
    d = s.join(F.broadcast(tags), "suggested", "left")
    status = F.when(F.col("suggested").isNull(), "no-rule").when(F.col("tag_id").isNull(), "missing-tag").when(F.col("stored").isNull(), "new").when(F.col("stored") == F.col("suggested"), "unchanged").otherwise("change")
    return d.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.min("security_id").alias("first"))


@query
def consistency_warnings(spark, sf):
    """Codes that a new statement both adds and lacks: a security that changed its name."""
    s = _snapshots(spark, sf).join(_instruments(spark, sf).select("security_id", (F.col("security_id") % 40).alias("code")), "security_id")
    old, new = s.where(f"as_of_date = date'{PREVIOUS}'").select("account_id", "security_id", "code"), s.where(f"as_of_date = date'{AS_OF}'").select("account_id", "security_id", "code")
    added, missing = new.join(old, ["account_id", "security_id"], "left_anti"), old.join(new, ["account_id", "security_id"], "left_anti")
    return added.select("account_id", "code").intersect(missing.select("account_id", "code"))


DIVISORS = (1, 100, 1_000, 10_000)


@query
def divisor_inference(spark, sf):
    """The divisor of unit prices under which most rows satisfy quantity x price / divisor = amount within rounding; of equal ones the smaller."""
    d = _rich(spark, sf).select("security_id", "quantity", "gross", (F.floor(F.col("gross") / F.col("quantity")) * F.col("divisor")).alias("quote"))
    near = lambda by: F.abs(F.col("quantity") * F.col("quote") / by - F.col("gross")) <= 1 + F.col("quantity") * 0.5 / by
    g = d.groupBy("security_id").agg(*[F.count_if(near(v)).alias(f"_{v}") for v in DIVISORS], F.count("*").alias("n"))
    best = F.array_max(F.array(*[F.struct(F.col(f"_{v}").alias("hits"), F.lit(-v).alias("less")) for v in DIVISORS]))
    return g.select("security_id", (-best["less"]).alias("divisor"), best["hits"].alias("hits"), "n")
