"""Queries of names without a security, of prices to be fetched and prices now, and of statements' totals. Over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof, fetching, history, linking, lots, paths, replay, statements
from ..sources import domain as dm
from ..sources.domain import half_up
from ..sources.scratch import written
from .ledgers import REF, _replayed, _valued_lots
from .queries import AS_OF, GROUP, PREVIOUS
from .wealth import RICH, _instruments, _rich

QUERIES: dict = {}

PADDED = "lpad(CAST(security_id AS STRING), 4, '0')"
INDEX = "(l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey"
#: Statement rows: two names a security, codes in three forms, some securities known, prices of the month's end with strays.
NAMED = {
    "name": "concat('N', CAST(security_id AS STRING), CASE WHEN l_linenumber % 3 = 0 THEN 'old' ELSE '' END)",
    "code": f"CASE WHEN security_id % 4 <> 1 AND security_id < 10000 AND l_partkey % 3 = 0 THEN CASE l_linenumber % 3 WHEN 0 THEN concat('0', {PADDED}, '0000') WHEN 1 THEN concat({PADDED}, '0') ELSE {PADDED} END END",
    "known": "CASE WHEN security_id % 5 = 0 AND l_linenumber % 3 <> 0 THEN security_id END",
    "type": "CASE WHEN kind = 'other' AND security_id % 3 <> 0 THEN 'buy' ELSE kind END",
    "margin": "l_partkey % 41 = 0",
    "still": "l_partkey % 53 = 0",
    "off_market": "l_partkey % 59 = 0",
    "signed": "CASE WHEN kind IN ('sell', 'transfer_out') THEN -quantity ELSE quantity END",
    "at_price": "CAST(price + CASE WHEN l_partkey % 97 = 0 THEN 50 ELSE 0 END AS DOUBLE)",
}
TWIN = 100_000_000
#: What is known of a candidate, by its id (c) and its group's security (s).
CANDIDATE = {"refined": "(c % 10) / 10.0", "comparable": "CASE c % 4 WHEN 0 THEN 'x債券' WHEN 1 THEN '先進国株式' WHEN 2 THEN '国内株式' ELSE 'バランス株式' END", "group_comparable": "CASE WHEN s % 2 = 0 THEN '国内株式' ELSE '先進国株式ファンド' END", "code": "CASE WHEN c % 2 = 0 AND c < 10000 THEN lpad(CAST(c AS STRING), 4, '0') END"}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _named(spark: SparkSession, sf: str) -> DataFrame:
    return _named_by(spark, sf, *_stored_prices(spark, sf))


def _stored_prices(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(what statement rows need of the ledger, prices): the ledger is joined once, its prices are added up once."""
    ledger = written(dm.ledger(spark, sf).select("security_id", "trade_date", "tx_type", "quantity", "gross", "l_orderkey", "l_linenumber", "l_partkey"), "ledger")
    return ledger, written(dm.prices(ledger), "prices")


def _named_by(spark: SparkSession, sf: str, ledger: DataFrame, prices: DataFrame) -> DataFrame:
    kinds = ledger.select("*", F.expr(RICH["kind"]).alias("kind"))
    d = kinds.withColumn("day", F.last_day("trade_date")).join(prices.select("security_id", F.col("date").alias("day"), "price"), ["security_id", "day"])
    d = d.select(F.col("security_id").alias("own"), F.expr(INDEX).alias("row_index"), F.col("day").alias("trade_date"), *[F.expr(x).alias(k) for k, x in NAMED.items()])
    return d.withColumnsRenamed({"known": "security_id", "type": "kind", "at_price": "unit_price"}).withColumn("quantity", F.col("signed").cast("double")).drop("signed")


def _linked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, links, candidates with what speaks against them) of all statement rows."""
    ledger, prices = _stored_prices(spark, sf)
    rows = written(_named_by(spark, sf, ledger, prices), "statement-rows")
    keys, resolved = written(linking.name_keys(rows), "name-keys"), written(linking.resolved_keys(rows, "row_index"), "resolved-keys")
    members, groups = linking.merged_by_code(linking.entries(rows), keys)
    s = F.regexp_extract("group", "[0-9]+", 0).cast("long")
    c = groups.select("group", s.alias("s"), F.explode(F.when(s % 3 == 2, F.array(s + 7 + TWIN * 2)).otherwise(F.array_compact(F.array(s, s + 1, F.when(s % 6 == 0, s + TWIN))))).alias("c"))
    c = c.select("group", F.col("c").alias("security_id"), *[F.expr(x).alias(k) for k, x in CANDIDATE.items()])
    p = prices.where("security_id % 9 <> 4").withColumn("date", F.when(F.col("security_id") % 8 == 3, F.date_add("date", 2)).otherwise(F.col("date")))
    series = p.unionByName(p.withColumn("security_id", F.col("security_id") + TWIN))
    c = linking.weighed(c, linking.market_prices(rows, members), series)
    c = c.withColumn("refuted", linking.refuted())
    ids = dm.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("security_id"))
    alone = rows.where("own % 4 = 1 AND security_id IS NULL AND NOT margin AND NOT still AND kind NOT IN ('cash_in', 'cash_out', 'other') AND NOT endswith(name, 'old')").groupBy("own").agg(F.sum("quantity").alias("quantity"))
    holdings = alone.select((F.col("own") + TWIN * 3).alias("security_id"), "quantity").unionByName(alone.where("own % 16 = 1").select((F.col("own") + TWIN * 4).alias("security_id"), "quantity"))
    links = linking.decided(groups, members, keys, resolved, c, ids.where("security_id % 12 = 6"), holdings, rows.where("security_id IS NOT NULL").select("security_id").distinct())
    return groups, links, linking.live(c, links, members, keys, resolved)


@query
def name_links(spark, sf):
    """Every name without a security, grouped by codes: what it is linked with, by which evidence, or what is to be done about it."""
    groups, links, candidates = _linked(spark, sf)
    return linking.outlook(groups, links, candidates)


@query
def link_candidates(spark, sf):
    """Every candidate of a name: what prices say, and what speaks against it."""
    return _linked(spark, sf)[2].select("group", "security_id", "checked", "matched", "shifted", "verdict", "against")


#: Rows of sold securities.
SOLD = {"name": "concat('S', CAST(security_id AS STRING))", "code": f"CASE WHEN security_id % 3 = 0 AND security_id < 10000 THEN CASE WHEN l_partkey % 2 = 0 THEN concat({PADDED}, '0') ELSE 'ABC' END END", "price": "CAST(floor(gross / quantity) * divisor AS DOUBLE)", "paid": "CASE WHEN l_linenumber % 4 = 0 THEN 0 ELSE gross END", "got": "CASE WHEN l_linenumber % 8 <> 4 THEN -gross END", "money": "CASE WHEN l_partkey % 3 = 0 THEN '' WHEN l_partkey % 3 = 1 THEN currency ELSE 'EUR' END"}


@query
def closed_securities(spark, sf):
    """Securities that could be made from the rows of every name."""
    d = _rich(spark, sf).select(F.expr(INDEX).alias("row_index"), "quantity", *[F.expr(x).alias(k) for k, x in SOLD.items()]).withColumnsRenamed({"price": "unit_price", "paid": "gross", "got": "net", "money": "currency"})
    return linking.closed_securities(d, "row_index")


SOURCE = "CASE security_id % 6 WHEN 0 THEN 'fund' WHEN 1 THEN 'coin' WHEN 2 THEN 'metal' WHEN 3 THEN 'none' ELSE 'equity' END"
SERIES_REF = "CASE WHEN security_id % 6 = 2 THEN concat('M', CAST(security_id % 4 AS STRING)) WHEN security_id % 23 <> 7 THEN concat('R', CAST(security_id AS STRING)) END"
SPOT = {"status": "CASE security_id % 5 WHEN 0 THEN 'manual' WHEN 1 THEN 'unlinked' ELSE 'linked' END", "source": SOURCE, "ref": SERIES_REF, "inactive": "security_id % 19 = 0"}
NOW, TODAY = 1_000, "1997-06-15"
#: Days on which a property was appraised: long ago, later only, or before and after today.
APPRAISED = "CASE security_id % 15 WHEN 0 THEN year(date) <= 1995 WHEN 5 THEN year(date) >= 1998 ELSE month(date) % 4 = 1 END"


@query
def current_spots(spark, sf):
    """The price of every security now: stored, asked for, composed, brought to today by an index, or the last close; with doubts."""
    p = written(dm.prices(dm.ledger(spark, sf)), "prices")
    last = p.groupBy("security_id").agg(F.max_by("price", "date").alias("price")).withColumns({"source": F.expr(SOURCE), "ref": F.expr(SERIES_REF)})
    d = p.withColumns({"source": F.expr(SOURCE), "ref": F.expr(SERIES_REF), "currency": F.expr("CASE WHEN security_id % 13 = 0 THEN 'USD' END")})
    manual = d.where("security_id % 5 = 0").withColumns({"source": F.lit("manual"), "ref": F.col("security_id").cast("string")})
    daily = d.where("source NOT IN ('none', 'metal') AND security_id % 7 <> 3").unionByName(manual).select("source", "ref", "date", "price", "currency")
    asked = last.where("source IN ('coin', 'equity') AND ref IS NOT NULL")
    cache = asked.where("security_id % 4 = 0").select("source", "ref", (F.col("price") + 1).alias("price"), F.lit("JPY").alias("currency"), (F.col("security_id") % 100 * 10).alias("fetched_at"))
    quotes = asked.where("security_id % 4 <> 1").select("source", "ref", F.expr("CASE WHEN security_id % 8 <> 2 THEN price + 2 END").alias("price"), F.expr("CASE WHEN security_id % 4 = 2 THEN 'USD' END").alias("currency"))
    parts = last.where("security_id IN (1, 2, 3)").select(F.expr("CASE WHEN security_id = 3 THEN 'fx' ELSE 'future' END").alias("source"), F.expr("CASE security_id WHEN 3 THEN 'USD' ELSE concat('F', CAST(security_id AS STRING)) END").alias("ref"), "price", F.lit("USD").alias("currency"))
    series = daily.select("source", "ref").unionByName(quotes.select("source", "ref")).unionByName(cache.select("source", "ref"))
    components = fetching.source_spots(parts, daily, cache, parts, NOW)
    metals = last.where("source = 'metal'").select("ref").distinct().select("ref", F.expr("CASE ref WHEN 'M0' THEN 'F1' WHEN 'M2' THEN 'F2' END").alias("future"))
    composed = fetching.metal_quotes(metals, components).withColumn("price", F.col("price").cast("double"))
    quotes = quotes.withColumn("price", F.col("price").cast("double")).unionByName(composed)
    spots = fetching.source_spots(series.unionByName(composed.select("source", "ref")), daily, cache, quotes, NOW)
    appraisals = p.where(f"security_id % 5 = 0 AND {APPRAISED}").select("security_id", F.expr("concat('X', CAST(security_id % 4 AS STRING))").alias("index_ref"), "date", "price")
    index = p.where("security_id IN (1, 2, 3) AND month(date) % 3 = 0").select(F.expr("concat('X', CAST(security_id AS STRING))").alias("ref"), "date", F.expr("CASE WHEN month(date) = 12 THEN 0 ELSE price END").alias("level"))
    grown = fetching.extended(appraisals, index, F.lit(TODAY).cast("date"))
    s = _instruments(spark, sf).select("security_id", "currency", *[F.expr(x).alias(k) for k, x in SPOT.items()])
    out = fetching.security_spots(s, spots, grown)
    return out.select("security_id", half_up(F.col("price"), 2).alias("price"), "price_currency", "origin", F.array_join("warnings", ",").alias("warnings"))


FETCH = "CASE security_id % 3 WHEN 0 THEN 'fund' ELSE 'equity' END"
FETCH_DAY = "1998-12-01"


def _fetching(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(covered, attempts, plan): stretches after trades are covered, the rest of each series' years is wanted."""
    named = [F.expr(FETCH).alias("source"), F.col("security_id").cast("string").alias("ref")]
    tx = dm.ledger(spark, sf)
    covered = tx.where("account_id % 5 = 0").select(*named, F.col("trade_date").alias("start_date"), F.date_add("trade_date", (F.col("quantity") % 30).cast("int")).alias("end_date"))
    s = dm.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("security_id"))
    wanted = s.select(*named, F.explode(F.array(F.struct(F.lit("1994-01-01").cast("date").alias("start_date"), F.lit("1995-03-31").cast("date").alias("end_date")), F.struct(F.lit("1995-04-01").cast("date").alias("start_date"), F.lit("1995-12-31").cast("date").alias("end_date")), F.struct(F.lit("1997-02-01").cast("date").alias("start_date"), F.lit("1997-12-31").cast("date").alias("end_date")))).alias("x")).select("source", "ref", "x.*")
    attempts = s.where("security_id % 5 <> 4").select(*named, F.expr(f"CASE WHEN security_id % 5 = 2 THEN date_sub(DATE '{FETCH_DAY}', 1) ELSE DATE '{FETCH_DAY}' END").alias("attempted_on"), F.expr("security_id % 5 = 1").alias("ok"))
    return covered, attempts, fetching.fetch_plan(wanted, covered, attempts, F.lit(FETCH_DAY).cast("date"))


@query
def fetch_plan(spark, sf):
    """The stretches of every series that are worth a fetch."""
    return _fetching(spark, sf)[2]


def _recorded(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    covered, attempts, plan = _fetching(spark, sf)
    got = plan.where("day(gap_start) % 3 <> 2 AND CAST(ref AS BIGINT) % 7 <> 1").select("source", "ref", F.col("gap_start").alias("start_date"), F.expr("CASE WHEN day(gap_start) % 3 = 0 THEN gap_end ELSE date_add(gap_start, CAST(floor(datediff(gap_end, gap_start) / 2) AS INT)) END").alias("end_date"))
    return fetching.recorded(covered, attempts, plan, got, F.lit(FETCH_DAY).cast("date"))


@query
def recorded_ranges(spark, sf):
    """What is covered after fetches of which some brought everything, some half and some nothing."""
    return _recorded(spark, sf)[0]


@query
def recorded_attempts(spark, sf):
    """The last attempt of every series after those fetches."""
    return _recorded(spark, sf)[1]


@query
def composable_gaps(spark, sf):
    """Months of every series composed of a future and a rate: may they be called covered?"""
    tx = written(dm.ledger(spark, sf).where("account_id % 4 = 1").select("security_id", "trade_date").distinct(), "trade-days")
    days = tx.select(F.concat(F.lit("F"), "security_id").alias("ref"), F.col("trade_date").alias("date"))
    months = tx.select("security_id", F.trunc("trade_date", "MM").alias("gap_start")).distinct().withColumn("gap_end", F.last_day("gap_start"))
    wanted = months.select(F.concat(F.lit("M"), "security_id").alias("ref"), F.concat(F.lit("F"), "security_id").alias("future"), F.expr("CASE WHEN security_id % 2 = 0 THEN 'USD' ELSE 'EUR' END").alias("currency"), "gap_start", "gap_end")
    covered = months.where("(security_id + month(gap_start)) % 3 <> 0").select(F.lit("future").alias("source"), F.concat(F.lit("F"), "security_id").alias("ref"), F.col("gap_start").alias("start_date"), F.col("gap_end").alias("end_date"))
    fx = days.groupBy().agg(F.min("date").alias("d")).select(F.lit("fx").alias("source"), F.explode(F.array(F.lit("USD"), F.lit("EUR"))).alias("ref"), F.expr("DATE '1992-01-01'").alias("start_date"), F.expr("CASE WHEN ref = 'USD' THEN DATE '1996-12-31' ELSE DATE '1999-12-31' END").alias("end_date"))
    rates = dm.prices(dm.ledger(spark, sf)).where("security_id IN (1, 2) AND month(date) % 3 = 0").select(F.expr("CASE WHEN security_id = 1 THEN 'EUR' ELSE 'USD' END").alias("ref"), F.date_sub("date", 12).alias("date"))
    return fetching.composable(wanted, covered.unionByName(fx), days, rates)


def _sections(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, stated totals, their sums): a statement for each account and month, a section for each fifth security."""
    d = _rich(spark, sf).select(F.concat_ws("-", "account_id", F.trunc("trade_date", "MM")).alias("batch"), F.concat(F.lit("s"), F.col("security_id") % 5).alias("section"), F.expr("CASE WHEN l_partkey % 23 <> 0 THEN gross END").alias("value"), "gross", "l_partkey")
    stated = d.where("section <> 's4'").groupBy("batch", "section").agg(F.sum("gross").alias("all"), F.min("l_partkey").alias("p")).select("batch", "section", F.expr("CASE WHEN p % 4 <> 3 THEN all END").alias("expected"))
    return d, stated.unionByName(stated.where("section = 's0'").select("batch", F.lit("empty").alias("section"), F.lit(0).cast("long").alias("expected"))), d.groupBy("batch").agg(F.sum("gross").alias("expected"), F.min("l_partkey").alias("p"))


@query
def section_totals(spark, sf):
    """Every section's total against that of its rows."""
    rows, stated, _ = _sections(spark, sf)
    return statements.section_totals(rows.select("batch", "section", "value"), stated)


@query
def grand_totals(spark, sf):
    """Every statement's total against that of its sections."""
    rows, stated, whole = _sections(spark, sf)
    found = statements.section_totals(rows.select("batch", "section", "value"), stated)
    return statements.grand_totals(found, whole.select("batch", F.expr("CASE WHEN p % 5 <> 1 THEN expected END").alias("expected")), rows.where("l_partkey % 50 = 0").select("batch"))


HOLDING = {
    "section": "CASE p_partkey % 7 WHEN 0 THEN 'deposit' WHEN 1 THEN 'crypto' WHEN 2 THEN 'stock' WHEN 3 THEN 'fund' WHEN 4 THEN 'pension' WHEN 5 THEN 'point' ELSE 'loan' END",
    "code": "CASE WHEN p_partkey % 3 <> 0 THEN CASE p_partkey % 4 WHEN 0 THEN 'ABCDEF' WHEN 1 THEN concat(lpad(CAST(p_partkey % 10000 AS STRING), 4, '0'), '0') ELSE lpad(CAST(p_partkey % 10000 AS STRING), 4, '0') END END",
    "institution": "CASE p_partkey % 11 WHEN 0 THEN '' WHEN 1 THEN ' ' WHEN 2 THEN NULL ELSE p_brand END",
    "quantity": "CAST(p_size AS DOUBLE)",
    "avg_cost": "CASE WHEN p_partkey % 5 <> 0 THEN floor(p_retailprice) END",
    "price": "floor(p_retailprice) + 1",
    "value": "floor(p_retailprice) * p_size",
    "point_type": "CASE p_partkey % 4 WHEN 1 THEN p_type WHEN 3 THEN '' END",
    "expiry": "CASE p_partkey % 6 WHEN 5 THEN '2030-01' WHEN 3 THEN '' END",
    "confidence": "CASE WHEN p_partkey % 13 = 0 THEN 0.2D ELSE 1.0D END",
}


@query
def statement_targets(spark, sf):
    """What every row of a statement becomes."""
    p = dm.table(spark, sf, "part")
    return statements.targets(p.select(F.col("p_partkey").alias("ref"), F.col("p_name").alias("name"), *[F.expr(x).alias(k) for k, x in HOLDING.items()]))


ACQUIRED = "CASE WHEN (account_id * security_id) % 2 = 0 THEN DATE '1991-05-01' WHEN (account_id + security_id) % 3 = 0 THEN DATE '2001-01-01' END"


@query
def carried_back(spark, sf):
    """Quantities that are drawn back beyond any record, with what a purchase that fills them in would be."""
    ledger = dm.stored_ledger(spark, sf)
    tx, lots = _rich(spark, sf, ledger).withColumn("ref", F.expr(REF)), written(_valued_lots(spark, sf, ledger), "lots")
    basis = _replayed(spark, sf, ledger).select(*GROUP, F.col("opening_cost").alias("residual_cost"))
    d = statements.carried_back(paths.quantity_paths(tx, lots, dm.ORDER), lots.withColumn("acquired_on", F.expr(ACQUIRED)), _instruments(spark, sf), basis)
    return d.select(*GROUP, half_up(F.col("quantity"), 4).alias("quantity"), "until", half_up(F.col("unit_price"), 2).alias("unit_price"), "acquired_on")


#: Rows of a statement and the lots known before it: five securities an account; costs and quantities of few values, so that many tie.
LOT_ROW = {
    "section": "CASE security_id % 5 WHEN 0 THEN 'point' WHEN 1 THEN 'deposit' ELSE 'stock' END",
    "old_label": "concat('p', CAST(security_id % 3 AS STRING), CASE WHEN security_id % 4 <> 0 THEN concat('|', CAST(1990 + security_id % 7 AS STRING)) ELSE '' END)",
    "new_label": "CASE WHEN security_id % 13 <> 0 THEN concat('p', CAST(security_id % 3 AS STRING), CASE WHEN security_id % 4 <> 0 THEN concat('|', CAST(1990 + security_id % 7 + security_id % 2 AS STRING)) ELSE '' END) END",
    "old_cost": "CASE WHEN security_id % 9 <> 4 AND bought > 0 THEN CAST(floor(cost / bought) % 50 AS DOUBLE) END",
    "new_cost": "CASE WHEN security_id % 9 <> 5 AND bought > 0 THEN CAST(floor(cost / bought) % 50 + security_id % 3 - 1 AS DOUBLE) END",
    "old_quantity": "CAST(quantity % 20 AS DOUBLE)",
    "new_quantity": "CAST(quantity % 20 + CASE WHEN security_id % 7 = 0 THEN 5 ELSE 0 END AS DOUBLE)",
}


@query
def lot_assignment(spark, sf):
    """Which known lot every row of a statement is, and what changed: by label and expiry, or by nearest cost."""
    s = asof.latest_at(dm.snapshots(dm.ledger(spark, sf)), GROUP, "as_of_date", {"now": F.lit(AS_OF).cast("date"), "then": F.lit(PREVIOUS).cast("date")})
    s = written(s, "positions")
    at = lambda name, *columns: s.where(f"{name} IS NOT NULL").select("account_id", F.col("security_id").alias("own"), "security_id", f"{name}.quantity", f"{name}.cost", f"{name}.bought").select("account_id", "own", *[F.expr(LOT_ROW[c]).alias(c.split("_")[-1]) for c in columns])
    rows = at("now", "section", "new_label", "new_cost", "new_quantity").where("own % 11 <> 0").withColumnRenamed("own", "row_id").withColumn("security_id", F.col("row_id") % 5)
    known = at("then", "old_label", "old_cost", "old_quantity").where("own % 8 <> 3").withColumnRenamed("own", "lot_seq").withColumn("security_id", F.col("lot_seq") % 5)
    return lots.diffed(rows, known)



def _targets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(targets in batches, accounts, securities, aliases): some of each are there already."""
    p = dm.table(spark, sf, "part")
    t = statements.targets(p.select(F.col("p_partkey").alias("ref"), F.col("p_name").alias("name"), *[F.expr(x).alias(k) for k, x in HOLDING.items()]))
    t = t.withColumns({"batch": F.expr("ref % 11 * 10 + ref % 10"), "security_id": F.expr("CASE WHEN ref % 17 = 0 THEN ref END")})
    accounts = t.where("trim(account) <> ''").groupBy(F.col("account").alias("name")).agg(F.min("ref").alias("account_id")).where("account_id % 2 = 0")
    securities = t.where("ref % 3 = 1 AND section IN ('stock', 'fund', 'point')").select(F.col("ref").alias("security_id"), "code", "name_key")
    return t, accounts, securities, t.where("ref % 10 = 1").select(F.col("name_key").alias("alias"), F.col("ref").alias("security_id"))


@query
def committed_targets(spark, sf):
    """The account and the security that every row of a statement is booked on; what isn't there is made once."""
    return lots.ensured(*_targets(spark, sf))[0]


@query
def committed_securities(spark, sf):
    """The securities that a commit makes."""
    return lots.ensured(*_targets(spark, sf))[2]


#: What a user chooses for names: another security, nothing, or by another spelling.
CHOICE = {"name": "CASE WHEN security_id % 4 < 2 THEN concat('N', CAST(security_id AS STRING)) ELSE concat('n ', CAST(security_id AS STRING), 'OLD') END", "to": "CASE WHEN security_id % 5 <> 3 THEN security_id + 1 END"}


@query
def name_overrides(spark, sf):
    """Rows after a user's choices: a choice for a name holds for the other names of its group, and for other spellings."""
    rows = written(_named(spark, sf), "statement-rows")
    members, _ = linking.merged_by_code(linking.entries(rows), written(linking.name_keys(rows), "name-keys"))
    s = dm.table(spark, sf, "supplier").where("s_suppkey % 3 <> 2").select(F.col("s_suppkey").alias("security_id"))
    choices = s.select(*[F.expr(x).alias(k) for k, x in CHOICE.items()]).withColumnRenamed("to", "security_id")
    d = rows.select("row_index", "name", "security_id", F.expr("CASE WHEN security_id IS NOT NULL THEN CASE WHEN own % 2 = 0 THEN 'price' ELSE 'code' END END").alias("matched_by"), F.expr("security_id IS NOT NULL").alias("included"), F.expr("CASE WHEN row_index % 7 = 0 THEN 0.5D ELSE 0.9D END").alias("confidence"), F.expr("row_index % 5 = 0").alias("duplicate"))
    return lots.overridden(d, choices, members).select("row_index", "security_id", "matched_by", "included")


@query
def coin_points(spark, sf):
    """What every coin was worth, how much of it was held and what one cost, day by day, from another service's answers."""
    e = dm.table(spark, sf, "events").groupBy(F.concat(F.lit("C"), "user_id").alias("symbol"), F.expr("CASE event_type WHEN 'view' THEN 'value' WHEN 'click' THEN 'balance' WHEN 'purchase' THEN 'price' END").alias("metric"), F.to_date("ts").alias("t"))
    d = e.agg(F.max(F.floor(F.col("value") * 100)).cast("long").alias("v"))
    return history.coin_points(d.select("symbol", "metric", "t", F.expr("CASE WHEN v % 10 <> 3 THEN v END").alias("value"), F.expr("CASE WHEN v % 9 <> 4 THEN v + 1 END").alias("balance"), F.expr("CASE WHEN v % 8 <> 5 THEN v + 2 END").alias("price")))
