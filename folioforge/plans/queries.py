"""The portfolio queries, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import allocation, asof, classify, inference, matching, series, valuation
from ..operators import ledger as lg
from ..sources import domain as dm
from ..sources.domain import half_up
from ..sources.scratch import shared_dir
from ..streaming import events as ev

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
AS_OF, PREVIOUS = "1998-06-30", "1998-05-31"
GROUP = ["account_id", "security_id"]
OPENING_COST = dm.OPENING * 100_000


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _snap(spark: SparkSession, sf: str) -> DataFrame:
    return dm.snapshots(dm.ledger(spark, sf))


@query
def latest_lot(spark, sf):
    return asof.latest_per_key(_snap(spark, sf), GROUP, "as_of_date")


@query
def holdings_as_of(spark, sf):
    return asof.latest_per_key(_snap(spark, sf), GROUP, "as_of_date", F.lit(AS_OF).cast("date"))


def _lookups(spark, sf):
    return dm.ledger(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "security_id", "trade_date")


@query
def asof_price_strict(spark, sf):
    tx = dm.ledger(spark, sf)
    d = asof.as_of(_lookups(spark, sf), dm.prices(tx), ["security_id"], "trade_date", "date", ["price"])
    return d.groupBy("security_id").agg(F.count("*").alias("lookups"), F.count("price").alias("found"), F.sum("price").alias("price_sum"))


@query
def asof_price_backfill(spark, sf):
    tx = dm.ledger(spark, sf)
    d = asof.as_of(_lookups(spark, sf), dm.prices(tx), ["security_id"], "trade_date", "date", ["price"], backfill=True)
    return d.groupBy("security_id").agg(F.count("*").alias("lookups"), F.count("price").alias("found"), F.sum("price").alias("price_sum"))


@query
def price_before(spark, sf):
    p = dm.prices(dm.ledger(spark, sf))
    return asof.latest_per_key(p, ["security_id"], "date", F.lit(AS_OF).cast("date"), strict=True)


@query
def prev_close_7d(spark, sf):
    c = dm.closes(spark, sf)
    d = asof.as_of(c.withColumnRenamed("price", "close"), c, ["event_type"], "date", "date", ["price"], strict=True, max_days=7)
    return d.select("event_type", "date", "close", F.col("price").alias("prev_close"), F.col("date_found").alias("prev_date"))


@query
def daily_close_last_tick(spark, sf):
    return dm.closes(spark, sf)


def _lots(spark, sf):
    """Lots of AS_OF with their price, and the previous month's quantity and price."""
    tx = dm.ledger(spark, sf)
    s, p = dm.snapshots(tx), dm.prices(tx)
    day, prev = F.lit(AS_OF).cast("date"), F.lit(PREVIOUS).cast("date")
    d = asof.latest_at(s, GROUP, "as_of_date", {"cur": day, "old": prev}).where("cur is not null")
    d = d.select(*GROUP, "cur.quantity", "cur.cost", "cur.bought", F.col("old.quantity").alias("prev_quantity"))
    q = asof.latest_at(p, ["security_id"], "date", {"now": day, "then": prev})
    d = d.join(q.select("security_id", F.col("now.price").alias("price"), F.col("then.price").alias("prev_price")), "security_id", "left")
    return valuation.valued(d)


@query
def holding_value(spark, sf):
    return _lots(spark, sf).select(*GROUP, "quantity", "price", "value")


@query
def holding_pl(spark, sf):
    return _lots(spark, sf).select(*GROUP, "lot_cost", "pl", valuation.ratio(F.col("pl") * 100, F.col("lot_cost"), 2).alias("pl_pct"))


@query
def day_change(spark, sf):
    return _lots(spark, sf).select(*GROUP, "prev_value", "day_change")


@query
def class_summary(spark, sf):
    d = _lots(spark, sf).join(dm.securities(spark, sf), "security_id")
    return valuation.rolled_up(d, "asset_class")


@query
def account_summary(spark, sf):
    return valuation.rolled_up(_lots(spark, sf), "account_id")


@query
def by_security_merge(spark, sf):
    return valuation.merged_by_security(_lots(spark, sf))


@query
def totals_block(spark, sf):
    d = _lots(spark, sf)
    return d.agg(F.sum("value").alias("value"), F.sum("lot_cost").alias("cost"), F.sum("pl").alias("pl"), F.sum("day_change").alias("day_change"), F.count("*").alias("lots"), F.bool_or(F.col("day_change").isNull()).alias("day_change_partial"))


@query
def top_holdings_nulls_last(spark, sf):
    return valuation.top_nulls_last(_lots(spark, sf).select(*GROUP, "value"), "value", GROUP, 20)


@query
def others_bucket(spark, sf):
    d = _lots(spark, sf).join(dm.securities(spark, sf), "security_id").groupBy("asset_class").agg(F.sum("value").alias("value"))
    return valuation.others(d, "asset_class", "value", 0.05)


@query
def daily_position_value(spark, sf):
    tx = dm.ledger(spark, sf)
    d = series.on_calendar(dm.snapshots(tx).select(*GROUP, "as_of_date", "quantity"), GROUP, "as_of_date", "1998-01-01", "1998-01-31")
    p = series.on_calendar(dm.prices(tx), ["security_id"], "date", "1998-01-01", "1998-01-31").select("security_id", "day", "price")
    d = d.join(p, ["security_id", "day"])
    return d.groupBy("day").agg(F.sum(F.col("quantity") * F.col("price")).alias("value"), F.sum(F.col("backfilled").cast("long")).alias("backfilled"))


@query
def daily_series_by_class(spark, sf):
    tx = dm.ledger(spark, sf)
    d = series.on_calendar(dm.snapshots(tx).select(*GROUP, "as_of_date", "quantity"), GROUP, "as_of_date", "1998-01-01", "1998-01-31")
    p = series.on_calendar(dm.prices(tx), ["security_id"], "date", "1998-01-01", "1998-01-31").select("security_id", "day", "price")
    d = d.join(p, ["security_id", "day"]).join(dm.securities(spark, sf), "security_id")
    return d.groupBy("asset_class", "day").agg(F.sum(F.col("quantity") * F.col("price")).alias("value"))


@query
def ffill_gaps(spark, sf):
    return series.forward_filled(dm.closes(spark, sf).where("dayofmonth(date) % 3 <> 0"), ["event_type"], "date", "price")


@query
def metal_compose(spark, sf):
    """Futures in another unit and currency: the rate's own days, carried forward, meet the futures' on the date."""
    c = dm.closes(spark, sf)
    futures = c.where("event_type = 'purchase'").select("date", F.col("price").alias("future"))
    rate = series.on_calendar(c.where("event_type = 'view' and dayofmonth(date) % 2 = 1"), ["event_type"], "date", "2024-01-01", "2024-12-31").where("not backfilled")
    d = futures.join(rate.select(F.col("day").alias("date"), F.col("price").alias("fx")), "date")
    return d.select("date", half_up(F.col("future") * F.col("fx") / 31.1034768, 6).alias("gram_price"))


def _index(spark, sf):
    return dm.closes(spark, sf).where("dayofmonth(date) in (3, 10, 17, 24)")


@query
def index_interpolate(spark, sf):
    return series.interpolated(_index(spark, sf), ["event_type"], "date", "price", "2024-01-01", "2024-01-30")


@query
def chain_link(spark, sf):
    index = series.interpolated(_index(spark, sf), ["event_type"], "date", "price", "2024-01-01", "2024-01-30")
    anchors = dm.closes(spark, sf).where("dayofmonth(date) in (1, 12, 28)").select("event_type", "date", F.floor(F.col("price") * 1000).alias("value"))
    return series.chain_linked(anchors, index, ["event_type"])


def _ranges(spark, sf):
    return dm.ledger(spark, sf).select("security_id", F.col("trade_date").alias("start_date"), F.date_add("trade_date", (F.col("quantity") % 9).cast("int")).alias("end_date"))


@query
def merge_ranges(spark, sf):
    return series.merged_ranges(_ranges(spark, sf), ["security_id"])


@query
def missing_ranges(spark, sf):
    return series.missing_ranges(_ranges(spark, sf), ["security_id"], "1996-01-01", "1999-12-31")


@query
def ledger_page(spark, sf):
    d = dm.ledger(spark, sf).where("account_id = 3 and tx_type = 'buy'")
    return d.orderBy(F.desc("trade_date"), F.desc("l_orderkey"), F.desc("l_linenumber"), F.desc("l_partkey")).offset(50).limit(50).select("trade_date", "l_orderkey", "l_linenumber", "l_partkey", "security_id", "quantity", "gross")


@query
def running_balance(spark, sf):
    return lg.end_of_day(dm.ledger(spark, sf), dm.OPENING)


@query
def moving_avg_cost(spark, sf):
    d = lg.pooled(dm.ledger(spark, sf), dm.OPENING, F.lit(OPENING_COST))
    last = d.groupBy(*GROUP).agg(F.max_by(F.struct("pool", "balance"), F.struct(*dm.ORDER)).alias("x"))
    return last.select(*GROUP, F.col("x.balance").alias("balance"), half_up(F.col("x.pool"), 0).alias("pool"), half_up(F.try_divide("x.pool", F.col("x.balance").cast("double")), 2).alias("avg_cost"))


@query
def realized_pl(spark, sf):
    d = lg.realized(dm.ledger(spark, sf), dm.OPENING, F.lit(OPENING_COST))
    return d.groupBy(*GROUP).agg(F.count("*").alias("sales"), half_up(F.sum("realized"), 0).alias("realized"))


@query
def coverage_flags(spark, sf):
    tx = dm.ledger(spark, sf)
    s = asof.latest_per_key(dm.snapshots(tx), GROUP, "as_of_date").select(*GROUP, "quantity", (F.col("quantity") * 120_000).alias("pool"))
    return lg.reconciled(tx, s, F.lit(dm.OPENING))


@query
def opening_quantity(spark, sf):
    tx = dm.ledger(spark, sf)
    flow = tx.groupBy(*GROUP).agg(F.sum(dm.signed()).alias("change"))
    s = asof.latest_per_key(dm.snapshots(tx), GROUP, "as_of_date").select(*GROUP, "quantity")
    return s.join(flow, GROUP).select(*GROUP, (F.col("quantity") - F.col("change")).alias("opening_quantity"))


@query
def income_and_tax(spark, sf):
    d = dm.ledger(spark, sf)
    return d.groupBy(*GROUP).agg(F.sum(F.when(F.col("tx_type") == "reinvest", F.col("gross"))).alias("income"), F.sum("tax").alias("tax"), F.sum("fee").alias("fee"), F.min(F.when(F.col("tx_type") == "buy", F.col("trade_date"))).alias("first_buy"))


CONTENT = ["account_id", "security_id", "trade_date", "tx_type", "quantity"]


@query
def occurrence_no(spark, sf):
    d = lg.occurrence(dm.ledger(spark, sf), CONTENT)
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "security_id", F.col("occurrence").cast("long").alias("occurrence"))


@query
def dedup_key(spark, sf):
    d = lg.occurrence(dm.ledger(spark, sf), CONTENT)
    key = F.unhex(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in [*CONTENT, "occurrence"]]), 256))
    # equal keys meet once, as bytes, which order as their digits do; shards then are sums
    k = d.groupBy(key.alias("key")).agg(F.count("*").alias("n")).groupBy(F.lower(F.hex(F.substring("key", 1, 1))).alias("shard"))
    return k.agg(F.sum("n").alias("rows"), F.count("*").alias("keys"), F.lower(F.hex(F.min("key"))).alias("first_key"))


@query
def closed_positions(spark, sf):
    """Groups of the ledger without a trade in its last years."""
    tx = dm.ledger(spark, sf)
    open_ = tx.where("trade_date >= date'2000-01-01'").select(*GROUP).distinct()
    return tx.join(open_, GROUP, "left_anti").groupBy(*GROUP).agg(F.sum(dm.signed()).alias("net"), F.max("trade_date").alias("last_trade"))


def _weights(spark, sf):
    s = dm.securities(spark, sf).select("security_id")
    one = s.select("security_id", (F.col("security_id") % 4 + 1).alias("tag_id"), (F.col("security_id") % 7 * 10 + 20).alias("weight"))
    two = s.where("security_id % 3 = 0").select("security_id", F.lit(5).cast("long").alias("tag_id"), F.lit(15).cast("long").alias("weight"))
    return one.unionByName(two)


def _by_security(spark, sf):
    return _lots(spark, sf).groupBy("security_id").agg(F.sum("value").alias("value"))


@query
def tag_summary(spark, sf):
    d = allocation.shares(_by_security(spark, sf), _weights(spark, sf))
    return d.groupBy("tag_id").agg(half_up(F.sum("part"), 0).alias("value"), F.count("*").alias("holding_count"))


@query
def untagged_remainder(spark, sf):
    d = allocation.shares(_by_security(spark, sf), _weights(spark, sf)).where("tag_id = 0")
    return d.select("security_id", F.col("weight").cast("long").alias("weight"), half_up(F.col("part"), 0).alias("value"))


@query
def under_allocated(spark, sf):
    w = _weights(spark, sf).groupBy("security_id").agg(F.sum("weight").alias("used")).where("used < 100")
    return _by_security(spark, sf).join(w, "security_id").select("security_id", "used", "value")


@query
def portfolio_ratio(spark, sf):
    s = dm.securities(spark, sf).select("security_id")
    return allocation.portfolio_ratio(s, _weights(spark, sf), [1, 2, 5], F.col("security_id") % 11 == 0, F.col("security_id") % 13 == 0)


@query
def breakdown_grouping_sets(spark, sf):
    d = _lots(spark, sf).join(dm.securities(spark, sf), "security_id")
    g = d.groupingSets([[F.col("asset_class")], [F.col("account_id")], [F.col("region_id")]], F.col("asset_class"), F.col("account_id"), F.col("region_id"))
    return g.agg(F.sum("value").alias("value"), F.count("*").alias("lots"))


RULES = [(1, "steel|copper", "", "metals"), (2, "large", "brass", "large"), (3, "small|medium", "", "small"), (4, "plated", "", "plated")]


@query
def rule_match(spark, sf):
    p = dm.table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("label"))
    return allocation.first_rule(p, RULES, "label").groupBy("rule_tag").agg(F.count("*").alias("parts"))


@query
def resolve_by_code_then_name(spark, sf):
    p = dm.table(spark, sf, "part")
    key = fx.name_key(F.col("p_name"))
    names = p.select(F.col("p_partkey").alias("ref"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("C"), F.col("p_partkey"))).alias("code"), F.when(F.col("p_partkey") % 5 == 0, F.concat(key, F.lit("x"))).otherwise(key).alias("name_key"))
    codes = p.where("p_partkey % 6 = 0").select(F.concat(F.lit("C"), F.col("p_partkey")).alias("code"), F.col("p_partkey").alias("security_id"))
    aliases = p.groupBy(key.alias("alias")).agg(F.min("p_partkey").alias("security_id")).where("security_id % 2 = 0")
    keys = p.select(key.alias("name_key"), F.col("p_partkey").alias("security_id"))
    return matching.resolved(names, codes, aliases, keys)


@query
def snapshot_diff(spark, sf):
    s = _snap(spark, sf).select(*GROUP, "as_of_date", "quantity", "cost")
    old = s.where(f"as_of_date = date'{PREVIOUS}'")
    return matching.snapshot_diff(old, s.where(f"as_of_date = date'{AS_OF}'"), GROUP)


def _refs(spark, sf):
    return dm.ledger(spark, sf).withColumn("ref", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "security_id"))


@query
def transfer_candidates(spark, sf):
    t = _refs(spark, sf)
    return matching.transfer_candidates(t.where("tx_type = 'sell'"), t.where("tx_type = 'buy'")).select("out_ref", "in_ref", "days", "gap", "rank")


@query
def price_verify(spark, sf):
    tx = _refs(spark, sf)
    t = tx.select("security_id", "ref", "trade_date", F.expr("gross div quantity").alias("unit_price"))
    return matching.price_confirmed(t, dm.prices(dm.ledger(spark, sf)), 0.3)


@query
def dup_security_survivor(spark, sf):
    li = dm.table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("trades"), F.to_date(F.max("l_shipdate")).alias("last_trade"))
    p = dm.table(spark, sf, "part").join(li, F.col("p_partkey") == F.col("l_partkey"), "left")
    s = p.select(F.col("p_partkey").alias("security_id"), "p_name", F.coalesce("trades", F.lit(0)).alias("trades"), "last_trade")
    return matching.survivors(s, "p_name").select("security_id", "survivor", "members")


@query
def unexplained_holdings(spark, sf):
    tx = dm.ledger(spark, sf)
    return asof.latest_per_key(dm.snapshots(tx), GROUP, "as_of_date").join(tx.where("tx_type = 'buy'").select(*GROUP).distinct(), GROUP, "left_anti").select(*GROUP, "quantity")


@query
def quantity_unique_match(spark, sf):
    tx = dm.ledger(spark, sf)
    left = tx.where("tx_type = 'sell'").groupBy(*GROUP).agg(F.sum("quantity").alias("total")).select(F.col("security_id").alias("l_security"), "account_id", "total")
    right = tx.where("tx_type = 'buy'").groupBy(*GROUP).agg(F.sum("quantity").alias("total")).select(F.col("security_id").alias("r_security"), "account_id", "total")
    return matching.unique_matches(left, right, ["account_id", "total"])


@query
def code_components(spark, sf):
    """Suppliers that share parts, directly or through others, over every row."""
    return matching.code_components(dm.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_partkey").alias("code")))


@query
def code_components_whole(spark, sf):
    """The same; the name under which the whole table was first covered."""
    return code_components(spark, sf)


@query
def column_stats(spark, sf):
    """Statistics of every column in long form: one pass, whatever the number of columns."""
    c = dm.table(spark, sf, "customer")
    cells = c.select(F.explode(F.array(*[F.struct(F.lit(x).alias("col"), F.col(x).cast("string").alias("v")) for x in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")])).alias("x")).select("x.*")
    number = F.col("v").rlike(r"^-?[0-9]+(\.[0-9]+)?$")
    return cells.groupBy("col").agg(F.count("*").alias("cells"), F.count("v").alias("filled"), F.countDistinct("v").alias("distinct_values"), F.sum(number.cast("long")).alias("numbers"), F.max(F.length("v")).cast("long").alias("longest"), half_up(F.avg(F.length("v")), 4).alias("mean_length"))


@query
def identity_check(spark, sf):
    """Share of rows in which quantity x price meets the amount within a tolerance, per flag."""
    d = dm.table(spark, sf, "lineitem").join(dm.table(spark, sf, "part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    near = F.abs(F.col("l_quantity") * F.col("p_retailprice") - F.col("l_extendedprice")) <= 0.1 * F.col("l_extendedprice")
    return d.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(near.cast("long")).alias("hits"))


@query
def normalize_name(spark, sf):
    p = dm.table(spark, sf, "part")
    return p.groupBy(fx.name_key(F.concat(F.col("p_name"), F.lit(" (12)"))).alias("name_key")).agg(F.count("*").alias("parts"), F.min("p_partkey").alias("first_part"))


@query
def parse_amount(spark, sf):
    c = dm.table(spark, sf, "customer")
    raw = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("("), F.format_number(-F.col("c_acctbal"), 2), F.lit(")"))).otherwise(F.format_number("c_acctbal", 2))
    value = fx.amount(raw)
    return c.groupBy("c_mktsegment").agg(F.count(value).alias("parsed"), F.sum(F.floor(value * 100 + 0.5).cast("long")).alias("cents"))


@query
def parse_date_multi(spark, sf):
    o = dm.table(spark, sf, "orders")
    d = F.to_date("o_orderdate")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "yyyyMMdd")).when(F.col("o_orderkey") % 3 == 1, F.date_format(d, "d.M.yyyy")).otherwise(F.date_format(d, "yyyy/M/d"))
    return o.groupBy(F.trunc(fx.any_date(raw, "dmy"), "MM").alias("month")).agg(F.count("*").alias("n"))


@query
def tx_type_classify(spark, sf):
    """Types of the ledger's rows from labels in two languages."""
    label = F.when(F.col("tx_type") == "buy", "買付（特定）").when(F.col("tx_type") == "reinvest", "分配金再投資").otherwise("Sell (market)")
    d = dm.ledger(spark, sf).withColumn("tx_type", classify.type_of(label)["kind"])
    return d.groupBy("tx_type").agg(F.count("*").alias("n"), F.sum(dm.signed()).alias("net_quantity"))


@query
def month_summary(spark, sf):
    d = dm.ledger(spark, sf)
    kinds = [F.sum((F.col("tx_type") == k).cast("long")).alias(k) for k in ("buy", "reinvest", "sell")]
    return d.groupBy(F.trunc("trade_date", "MM").alias("month")).agg(F.count("*").alias("n"), *kinds, F.sum("gross").alias("gross"))


@query
def stream_tumbling(spark, sf):
    d = ev.drained(ev.tumbling(ev.event_stream(spark, sf)), shared_dir(spark), ["start", "event_type"])
    return d.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "cents")


@query
def stream_dedup_count(spark, sf):
    e = ev.event_stream(spark, sf)
    return ev.drained(ev.deduplicated(e).groupBy("event_type").agg(F.count("*").alias("n")), shared_dir(spark), ["event_type"])


@query
def stream_session(spark, sf):
    d = ev.drained(ev.sessions(ev.event_stream(spark, sf)), shared_dir(spark))
    return d.select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "n")


@query
def fuzzy_name_score(spark, sf):
    """The five closest other names of each name, at a score of a half and more, and how alike they are without what they share."""
    n = dm.table(spark, sf, "part").select(F.col("p_name").alias("name"))
    return matching.suggested(n, n.withColumnRenamed("name", "other"))


@query
def price_priority(spark, sf):
    """One price a day: manual rows win over the linked series."""
    p = dm.prices(dm.ledger(spark, sf))
    manual = p.where("security_id % 5 = 0 and month(date) % 2 = 0").select("security_id", "date", (F.col("price") + 7).alias("price"), F.lit("manual").alias("source"), F.lit(1).alias("ord"))
    both = p.select("security_id", "date", "price", F.lit("linked").alias("source"), F.lit(2).alias("ord")).unionByName(manual)
    best = both.groupBy("security_id", "date").agg(F.min_by(F.struct("price", "source"), "ord").alias("x"))
    return best.select("security_id", "date", "x.price", "x.source")


@query
def latest_reported(spark, sf):
    p = dm.prices(dm.ledger(spark, sf)).withColumn("reported", F.when(F.month("date") % 3 == 0, F.col("price")))
    known = p.where("reported is not null").groupBy("security_id").agg(F.max_by("reported", "date").alias("reported"), F.max("date").alias("date"))
    return p.select("security_id").distinct().join(known, "security_id", "left")


@query
def upsert_snapshot(spark, sf):
    """Rows of a re-imported statement replace those with their key; the rest stays."""
    s = _snap(spark, sf).select(*GROUP, "as_of_date", "quantity").where("as_of_date between date'1998-05-01' and date'1998-06-30'")
    new = s.where(f"as_of_date = date'{AS_OF}' and security_id % 2 = 0").withColumn("quantity", F.col("quantity") + 1).withColumn("ord", F.lit(0))
    both = s.withColumn("ord", F.lit(1)).unionByName(new)
    return both.groupBy(*GROUP, "as_of_date").agg(F.min_by("quantity", "ord").alias("quantity"))


@query
def usage_counts(spark, sf):
    tx = dm.ledger(spark, sf)
    uses = tx.select("security_id").unionByName(_snap(spark, sf).select("security_id"))
    return dm.securities(spark, sf).select("security_id").join(uses.groupBy("security_id").agg(F.count("*").alias("uses")), "security_id", "left").select("security_id", F.coalesce("uses", F.lit(0)).alias("uses"))


@query
def prefix_unique(spark, sf):
    """Truncated names that only one full name continues: names meet by each of their beginnings that has a truncated name's length."""
    names = dm.table(spark, sf, "part").select("p_name").distinct()
    cut = names.select(F.expr("substring(p_name, 1, length(p_name) - 3)").alias("short")).distinct()
    lengths = F.array(*[F.lit(r.n) for r in cut.select(F.length("short").alias("n")).distinct().orderBy("n").collect()]).cast("array<int>")
    j = cut.join(names.select("p_name", F.explode(F.transform(F.filter(lengths, lambda n: n <= F.length("p_name")), lambda n: F.left(F.col("p_name"), n))).alias("short")), "short")
    return j.groupBy("short").agg(F.count("*").alias("n"), F.min("p_name").alias("full_name")).where("n = 1").select("short", "full_name")


@query
def class_drilldown(spark, sf):
    d = _lots(spark, sf).join(dm.securities(spark, sf).where("asset_class = 'NATION_7'"), "security_id")
    return d.groupBy("security_id").agg(F.sum("value").alias("value"), F.sum("pl").alias("pl"), F.sum("day_change").alias("day_change"), F.bool_or(F.col("day_change").isNull()).alias("day_change_partial"))


@query
def included_totals(spark, sf):
    """Rows of excluded classes stay, flagged; totals skip them."""
    d = _lots(spark, sf).join(dm.securities(spark, sf), "security_id").withColumn("in_total", ~F.col("region_id").isin(2, 4))
    return d.groupBy("region_id").agg(F.bool_and("in_total").alias("in_total"), F.sum("value").alias("value"), F.sum(F.when(F.col("in_total"), F.col("value"))).alias("value_in_total"), F.count("*").alias("lots"))


@query
def account_rollup(spark, sf):
    """Every account has a row, with or without holdings."""
    v = _lots(spark, sf).groupBy("account_id").agg(F.sum("value").alias("value"), F.countDistinct("security_id").alias("holdings"))
    a = dm.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("account_id"), F.col("n_name").alias("account"))
    return a.join(v, "account_id", "left").select("account_id", "account", "value", F.coalesce("holdings", F.lit(0)).alias("holdings"))


@query
def zero_transitions(spark, sf):
    """Month ends at which a position fell through its opening quantity."""
    w = Window.partitionBy(*GROUP).orderBy("as_of_date")
    d = _snap(spark, sf).withColumn("before", F.lag("quantity").over(w))
    return d.where((F.col("before") >= dm.OPENING) & (F.col("quantity") < dm.OPENING)).select(*GROUP, "as_of_date", "before", "quantity")


@query
def adjacent_pairs(spark, sf):
    """The last six pairs of neighbouring snapshots of a position."""
    w = Window.partitionBy(*GROUP).orderBy("as_of_date")
    d = _snap(spark, sf).select(*GROUP, "as_of_date", "quantity", F.lag("as_of_date").over(w).alias("prev_date"), F.lag("quantity").over(w).alias("prev_quantity")).where("prev_date is not null")
    back = Window.partitionBy(*GROUP).orderBy(F.desc("as_of_date"))
    return d.withColumn("n", F.row_number().over(back).cast("long")).where("n <= 6")


def _ranked(d: DataFrame, day: str, order: list[str]) -> DataFrame:
    """Position in the order of (day, order) over the whole table: rows of earlier days, then the place in the day.

    Only one row a day goes through the window without a partition.
    """
    days = d.groupBy(day).agg(F.count("*").alias("n"))
    days = days.select(F.col(day).alias("_day"), (F.sum("n").over(Window.orderBy(day)) - F.col("n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(day).orderBy(*order))
    return d.join(days, F.col(day) == F.col("_day")).withColumn("position", F.col("_before") + inside - 1).drop("_day", "_before")


@query
def even_sample(spark, sf):
    """At most 200 rows, evenly spaced over the whole ledger."""
    d = _ranked(dm.ledger(spark, sf), "trade_date", dm.ORDER[1:])
    n = d.agg(F.count("*").alias("total"))
    d = d.join(F.broadcast(n))
    slot = F.floor(F.col("position") * 200 / F.col("total"))
    return d.where((F.col("position") == 0) | (slot != F.floor((F.col("position") - 1) * 200 / F.col("total")))).select("position", "trade_date", "l_orderkey", "l_linenumber", "l_partkey")


@query
def longest_run(spark, sf):
    """Longest run of days in a row on which an account traded (gaps and islands); the earliest of equal ones."""
    d = dm.ledger(spark, sf).select("account_id", "trade_date").distinct()
    d = d.withColumn("island", F.date_sub("trade_date", F.row_number().over(Window.partitionBy("account_id").orderBy("trade_date"))))
    d = d.groupBy("account_id", "island").agg(F.count("*").alias("days"), F.min("trade_date").alias("start"))
    return d.groupBy("account_id").agg(F.max("days").alias("days"), F.min_by("start", F.struct(-F.col("days"), "start")).alias("start"))


@query
def median_abs(spark, sf):
    d = _lots(spark, sf).join(dm.securities(spark, sf), "security_id")
    return d.groupBy("asset_class").agg(half_up(F.median(F.abs("pl")), 1).alias("median_abs_pl"))


@query
def mode_larger(spark, sf):
    """The most frequent quantity of a type; of equally frequent ones the larger."""
    n = dm.ledger(spark, sf).groupBy("tx_type", "quantity").agg(F.count("*").alias("n"))
    return n.groupBy("tx_type").agg(F.max_by("quantity", F.struct("n", "quantity")).alias("quantity"), F.max("n").alias("n"))


@query
def weighted_cost(spark, sf):
    """Average cost weighted by quantity; unknown as soon as one part is unknown."""
    d = _lots(spark, sf).withColumn("unit", F.when((F.col("security_id") + F.col("account_id") * 13) % 211 != 0, F.expr("lot_cost div quantity")))
    known = F.bool_and(F.col("unit").isNotNull() & (F.col("unit") > 0))
    return d.groupBy("account_id").agg(F.when(known, half_up(F.try_divide(F.sum(F.col("quantity") * F.col("unit")).cast("double"), F.sum("quantity").cast("double")), 2)).alias("avg_cost"))


@query
def security_set_ops(spark, sf):
    tx = dm.ledger(spark, sf)
    a = tx.where("trade_date between date'1998-05-01' and date'1998-05-31'").select(*GROUP)
    b = tx.where("trade_date between date'1998-06-01' and date'1998-06-30'").select(*GROUP)
    parts = [(a.intersect(b), "both"), (a.subtract(b), "may_only"), (b.subtract(a), "june_only")]
    out = [d.select(*GROUP, F.lit(k).alias("part")) for d, k in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query
def early_negative(spark, sf):
    """First day on which a ledger without an opening quantity would be negative."""
    d = lg.end_of_day(dm.ledger(spark, sf), 0).where("balance < 0")
    return d.groupBy(*GROUP).agg(F.min("trade_date").alias("first_negative"), F.min_by("balance", "trade_date").alias("balance"))


@query
def numeric_roles(spark, sf):
    """Which columns are quantity, price and amount: only arithmetic can say."""
    li = dm.table(spark, sf, "lineitem").select("l_quantity", F.col("l_extendedprice"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"), "l_discount", (F.col("l_extendedprice") / F.col("l_quantity") * 10_000).alias("per_lot"))
    return inference.arithmetic_roles(li, ["l_quantity", "l_extendedprice", "unit", "l_discount", "per_lot"]).where("passed > 0.9 * checked")


@query
def date_orders(spark, sf):
    o = dm.table(spark, sf, "orders")
    d = F.to_date("o_orderdate")
    raw = F.when(F.col("o_orderstatus") == "F", F.date_format(d, "d.M.yyyy")).when(F.col("o_orderstatus") == "O", F.date_format(d, "M/d/yyyy")).otherwise(F.date_format(d, "yyyy-M-d"))
    return inference.date_order(o.select("o_orderstatus", raw.alias("raw")), ["o_orderstatus"], "raw")


@query
def sign_conventions(spark, sf):
    d = dm.ledger(spark, sf).select((F.col("account_id") % 3).alias("file"), F.when(F.col("account_id") % 3 == 0, dm.signed()).otherwise(F.col("quantity")).alias("q"), F.when((F.col("account_id") % 3 == 1) & (F.col("tx_type") == "sell"), -F.col("gross")).otherwise(F.col("gross")).alias("a"))
    return inference.sign_convention(d, ["file"], "q", "a")
