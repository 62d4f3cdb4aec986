"""Queries of what an import does with statement rows: types, checks, blank labels, search words, NAV checks, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import classify, merging, navs
from ..sources import domain as dm
from ..sources.domain import half_up
from ..sources.scratch import new_path, shared_dir, written
from ..streaming import watch
from .wealth import LABELS, _rich

QUERIES: dict = {}

#: Statement rows made from line items: labels of every kind, some blank or missing; amounts, some that don't agree.
ROW = {
    "file": "CAST(account_id AS STRING)",
    "row_index": "(l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey",
    "name": "CASE WHEN l_partkey % 23 = 0 THEN '' WHEN l_partkey % 29 = 0 THEN 'MRF fund' ELSE concat('S', CAST(security_id AS STRING)) END",
    "code": "CASE WHEN l_partkey % 3 = 0 THEN CAST(1000 + security_id AS STRING) END",
    "trade_date": "CASE WHEN l_partkey % 31 <> 0 THEN trade_date END",
    "settle_date": "CASE WHEN l_partkey % 62 <> 0 THEN settle_date END",
    "quantity": "CASE WHEN l_partkey % 37 = 0 THEN NULL WHEN l_partkey % 41 = 0 THEN CAST(-quantity AS DOUBLE) ELSE CAST(quantity AS DOUBLE) END",
    "unit_price": "CASE WHEN l_linenumber % 6 <> 5 THEN CAST(floor(gross / quantity) AS DOUBLE) * divisor END",
    "price_text": "CASE WHEN l_orderkey % 2 = 0 THEN '1:3' ELSE '2' END",
    "gross": "CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE CAST(gross - gross % quantity AS DOUBLE) + CASE WHEN l_partkey % 11 = 0 THEN 5000 ELSE 0 END END",
    "net": "CASE WHEN l_linenumber % 5 = 0 THEN NULL WHEN l_partkey % 2 = 0 THEN -CAST(gross - gross % quantity + fee + tax AS DOUBLE) ELSE CAST(gross - gross % quantity + fee + tax AS DOUBLE) END",
    "fee": "CASE WHEN l_partkey % 9 <> 0 THEN CAST(fee AS DOUBLE) END",
    "tax": "CAST(tax AS DOUBLE)",
    "sign_convention": "CASE account_id % 4 WHEN 0 THEN 'by_type' WHEN 1 THEN 'signed_quantity' WHEN 2 THEN 'signed_net' ELSE 'unsigned' END",
    "confidence": "0.9",
}
REF = ["l_orderkey", "l_linenumber", "l_partkey"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    d = _rich(spark, sf).select(*REF, "divisor", *[F.expr(x).alias(k) for k, x in ROW.items()])
    words = F.array(*[F.lit(x) for x in LABELS])
    return d.withColumn("label", F.get(words, ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % (len(LABELS) + 9)).cast("int")))


@query
def rows_to_transactions(spark, sf):
    """Every statement row's type, signs, split ratio, doubts and confidence."""
    d = classify.transactions(_rows(spark, sf))
    return d.select(*REF, "kind", "trade_date", "quantity", "gross", "net", half_up(F.col("split_ratio"), 4).alias("split_ratio"), "margin", "off_market", F.array_join("warnings", ",").alias("warnings"), half_up(F.col("confidence"), 2).alias("confidence"))


def _blank(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of one security a name, whose labels are blank for a third of the purchases; some files have no column of types."""
    d = _rich(spark, sf).select(*REF, F.col("account_id").cast("string").alias("file"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey")).alias("row_index"), F.concat(F.lit("S"), "security_id").alias("name"), "trade_date", F.expr("CAST(quantity AS DOUBLE) AS quantity"),
        F.expr("CAST(floor(gross / quantity) AS DOUBLE) * divisor AS unit_price"), F.expr("CAST(gross AS DOUBLE) AS gross"), F.expr("CAST(gross + fee AS DOUBLE) AS net"), "divisor", F.expr("account_id % 8 <> 7 AS has_type_column"), F.expr("CASE WHEN tx_type <> 'sell' AND l_partkey % 3 = 0 THEN '' WHEN tx_type = 'sell' THEN 'sell' WHEN l_partkey % 5 = 0 THEN 'transfer in' ELSE 'buy' END AS label"))
    kind = F.when(F.col("label") == "", "other").when(F.col("label") == "transfer in", "transfer_in").otherwise(F.col("label"))
    return d.withColumns({"kind": kind, "margin": F.lit(False), "warnings": F.when(kind == "other", F.array(F.lit("unknown_type"))).otherwise(F.array().cast("array<string>")), "confidence": F.when(kind == "other", 0.7).otherwise(0.9)})


@query
def blank_type_inference(spark, sf):
    """Purchases that a file leaves without a label, by what its balances prove; a quantity of more than a unit's rounding doesn't fit."""
    d = classify.blank_types(_blank(spark, sf))
    return d.select(*REF, "kind", "quantity", "net", "inferred", F.array_join("warnings", ",").alias("warnings"), half_up(F.col("confidence"), 2).alias("confidence"))


#: Fund names with what statements add to them.
DECORATED = "concat(p_name, CASE p_partkey % 5 WHEN 0 THEN ' (4711)' WHEN 1 THEN '【gold】' WHEN 2 THEN concat('(', p_name, ')') WHEN 3 THEN '<no fee>' ELSE ' (x)' END)"


@query
def fund_search_words(spark, sf):
    """What each decorated name is searched by, narrow to wide, and its cleaned form."""
    p = dm.table(spark, sf, "part").select("p_partkey", F.expr(DECORATED).alias("name"))
    return p.select("p_partkey", names.clean_name("name").alias("cleaned"), F.array_join(names.search_words("name"), "|").alias("searches"))


def _listing(spark: SparkSession, sf: str) -> DataFrame:
    """A folder's listings from events: a file for each user, one scan a day, a size that changes now and then."""
    e = dm.table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return e.select(F.datediff("day", F.lit("2024-01-01").cast("date")).cast("long").alias("scan"), F.col("day").cast("timestamp").alias("seen_at"), F.concat(F.lit("f"), "user_id").alias("name"), F.least("n", F.lit(2)).alias("size"), F.lit(7).cast("long").alias("mtime"))


@query
def ready_files(spark, sf):
    """Files that two scans after each other show alike, from a stream of listings that arrives in five parts."""
    path = new_path(spark, "listing")
    d = written(_listing(spark, sf), "listings")
    for part in range(5):  # one after the other, so that the stream meets them in order
        d.where(F.col("scan").between(part * 6, part * 6 + 5) | (F.lit(part == 4) & (F.col("scan") >= 30))).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return watch.drained_ready(stream, shared_dir(spark), 86_400)


@query
def accept_gate(spark, sf):
    """What of a preview may be committed by itself: a batch for each day and account, a section for each class."""
    d = _rich(spark, sf).select(F.concat_ws("-", "account_id", "trade_date").alias("batch"), F.concat(F.lit("s"), F.col("security_id") % 5).alias("section"), F.concat_ws("-", *REF).alias("key"), "l_partkey", "l_orderkey", "account_id")
    previews = d.select("batch", "account_id").distinct().select("batch", F.expr("CASE WHEN account_id % 9 = 4 THEN false WHEN account_id % 2 = 0 THEN true END").alias("total_ok"))
    sections = d.groupBy("batch", "section").agg(F.min("l_partkey").alias("p")).select("batch", "section", (F.col("section") != "s4").alias("included"), F.expr("CASE WHEN p % 3 = 0 THEN NULL ELSE p % 23 <> 1 END").alias("sums_ok"))
    rows = d.select("batch", "key", "section", F.expr("CASE l_partkey % 4 WHEN 0 THEN 'missing' ELSE 'new' END").alias("status"), F.expr("CASE l_orderkey % 3 WHEN 0 THEN NULL ELSE l_orderkey % 3 = 1 END").alias("included"))
    g = watch.accepted(previews, sections, rows)
    return g.withColumns({"reasons": F.array_join("reasons", "; "), "sections": F.array_join("sections", ",")})


def _navs(spark: SparkSession, sf: str, prices: DataFrame | None = None) -> DataFrame:
    """Monthly and mid-month prices of funds in cents: ref, date, nav."""
    p = prices or dm.prices(dm.ledger(spark, sf))
    return p.select(F.col("security_id").alias("ref"), F.explode(F.array(F.struct(F.col("date"), F.col("price").alias("nav")), F.struct(F.date_sub("date", 9).alias("date"), (F.col("price") + 50).alias("nav")))).alias("x")).select("ref", "x.date", "x.nav")


@query
def nav_verified(spark, sf):
    """Candidates of every reported price: its own series, the next security's, and a wrong price for some."""
    d = dm.prices(dm.ledger(spark, sf)).select("security_id", F.col("date"), F.col("price"))
    d = d.select(F.concat_ws("-", "security_id", "date").alias("id"), F.date_add("date", (F.col("security_id") % 12).cast("int")).alias("as_of"), F.expr("price + CASE security_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 50 ELSE 0 END").alias("reported"), F.explode(F.array(F.col("security_id"), F.col("security_id") + 1)).alias("ref"))
    return navs.verified(d, _navs(spark, sf))


def _stored_series(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(months, prices): the ledger is joined once, by months, and its prices are added up once."""
    m = dm.stored_months(spark, sf)
    return m, written(dm.month_prices(m), "prices")


def _pensions(months: DataFrame, prices: DataFrame) -> DataFrame:
    """Statements of pensions in cents: a value by the price of the month (some off), what was paid in so far, and quantity 1 for some."""
    s = dm.month_snapshots(months).join(prices.select("security_id", F.col("date").alias("as_of_date"), "price"), ["security_id", "as_of_date"])
    return s.select("account_id", "security_id", F.lit(0).alias("lot_seq"), "as_of_date", F.expr("CASE WHEN (account_id + security_id) % 13 = 0 THEN 0 WHEN security_id % 3 = 0 THEN quantity ELSE 1 END").alias("quantity"), F.expr("CASE WHEN security_id % 8 <> 5 THEN (quantity * 1000 * price + account_id % 4 * 40000) div 10000 END").alias("value"), F.expr("CASE WHEN account_id % 6 <> 0 THEN (quantity - 1000) * price div 10 END").alias("cost"))


@query
def nav_movements(spark, sf):
    """Do the prices of a fund, and of the next one, explain how a pension's values moved between its last statements?"""
    months, prices = _stored_series(spark, sf)
    pairs = written(navs.value_pairs(_pensions(months, prices)), "pairs")
    candidates = pairs.select("security_id").distinct().select("security_id", F.explode(F.array(F.col("security_id"), F.col("security_id") + 1)).alias("ref"))
    d = navs.movement_checked(pairs, candidates, _navs(spark, sf, prices))
    return d.withColumn("worst", half_up(F.col("worst"), 3))


@query
def pension_units(spark, sf):
    """Statements with their quantity in units that the value and the fund's prices give."""
    months, prices = _stored_series(spark, sf)
    d = _pensions(months, prices).select("account_id", "security_id", "lot_seq", F.date_add("as_of_date", (F.col("security_id") % 20).cast("int")).alias("as_of"), F.col("security_id").alias("ref"), "quantity", "value")
    d = written(d, "statements")
    manual = prices.where("month(date) % 4 = 0").select("security_id", "date", F.expr("price * 77 div 10").alias("value"))
    out = navs.rewritten_units(d, _navs(spark, sf, prices), manual)
    return out.withColumn("quantity", half_up(F.col("quantity"), 4))


#: Securities with a code, a price source and a name; some are doubles of another one.
SECURITY = {
    "asset_class": "CASE security_id % 5 WHEN 0 THEN 'fund' ELSE 'stock' END", "currency": "CASE security_id % 5 WHEN 1 THEN 'USD' ELSE 'JPY' END", "unit": "'unit'", "divisor": "1", "name_key": "CASE WHEN security_id % 20 = 12 THEN '' ELSE concat('n', CAST(security_id AS STRING)) END",
    "code": "CASE WHEN security_id % 20 <> 1 OR security_id % 3 = 0 THEN CAST(security_id AS STRING) END", "price_status": "CASE security_id % 4 WHEN 1 THEN 'unlinked' WHEN 2 THEN 'manual' ELSE 'linked' END", "price_ref": "CASE WHEN security_id % 4 <> 1 THEN concat('r', CAST(security_id AS STRING)) END",
}
DOUBLE = "CASE security_id % 20 WHEN 16 THEN security_id - 15 WHEN 11 THEN security_id - 10 WHEN 12 THEN security_id - 11 WHEN 13 THEN security_id END"


def _doubles(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    s = dm.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("security_id")).select("security_id", *[F.expr(x).alias(k) for k, x in SECURITY.items()])
    pairs = s.select(F.col("security_id").alias("source"), F.expr(DOUBLE).alias("target"), (-F.col("security_id")).alias("rank")).where("target is not null")
    return s, pairs.withColumn("rank", F.pmod(F.col("rank"), F.lit(1000)))


def _lots_to_merge(spark: SparkSession, sf: str) -> DataFrame:
    s = dm.snapshots(dm.ledger(spark, sf)).where("NOT (security_id % 20 = 1 AND account_id % 3 = 0)")
    return s.select("account_id", "security_id", F.expr("CASE WHEN (account_id + month(as_of_date)) % 4 = 0 THEN 1 + account_id % 2 * 3 ELSE 0 END").cast("int").alias("lot_seq"), "as_of_date", "quantity")


@query
def merge_conflicts(spark, sf):
    """Doubles that can't become one, and why."""
    return merging.mergeable(*_doubles(spark, sf))[1]


@query
def merged_lots(spark, sf):
    """Snapshots after doubles have become one: the lots' new numbers and what they hold."""
    d = merging.merged_snapshots(_lots_to_merge(spark, sf), merging.mergeable(*_doubles(spark, sf))[0])
    return d.groupBy("account_id", "security_id", "lot_seq").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"), F.countDistinct("as_of_date").alias("days"))


@query
def merged_securities(spark, sf):
    """Securities after doubles have become one, with the codes and price sources that they take, and the aliases that lead to them."""
    s, pairs = _doubles(spark, sf)
    m = merging.mergeable(s, pairs)[0]
    aliases = s.select(F.concat(F.lit("a"), F.col("security_id") % 70).alias("alias"), "security_id").groupBy("alias").agg(F.min("security_id").alias("security_id"))
    names_ = merging.merged_aliases(aliases, s, m).groupBy("security_id").agg(F.count("*").alias("aliases"))
    return merging.merged_securities(s, m).join(names_, "security_id", "left").select("security_id", "code", "price_status", "price_ref", F.coalesce("aliases", F.lit(0)).alias("aliases"))


@query
def merged_tags(spark, sf):
    """Weights of tags after doubles have become one: the target's own count, then those of the first double that has the tag."""
    s, pairs = _doubles(spark, sf)
    tags = s.select("security_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("security_id") % 4 + 1)).alias("tag_id")).withColumn("weight", F.col("security_id") % 9 * 10 + F.col("tag_id"))
    return merging.retargeted_once(tags, merging.mergeable(s, pairs)[0], ["security_id", "tag_id"])


@query
def link_suggestions(spark, sf):
    """Which price series a fund is linked to: by its reported price, by how its values moved, by its name."""
    p = dm.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("security_id"))
    months, prices = _stored_series(spark, sf)
    pairs = written(navs.value_pairs(_pensions(months, prices)), "pairs")
    navs_ = written(_navs(spark, sf, prices), "navs")
    c = p.select("security_id", F.explode(F.array(*[F.col("security_id") + i for i in range(4)])).alias("ref"))
    moved = navs.movement_checked(pairs, c, navs_).select("security_id", "ref", "explained")
    last = prices.groupBy("security_id").agg(F.max_by(F.struct("date", "price"), "date").alias("x"))
    asked = last.select("security_id", F.date_add("x.date", 3).alias("as_of"), F.expr("CASE security_id % 4 WHEN 0 THEN NULL WHEN 1 THEN x.price + 50 ELSE x.price END").alias("reported")).join(c, "security_id").withColumn("id", F.col("security_id").cast("string"))
    priced = navs.verified(asked, navs_).select(F.col("id").cast("long").alias("security_id"), "ref", "matched")
    d = c.join(priced, ["security_id", "ref"], "left").join(moved, ["security_id", "ref"], "left")
    d = d.withColumns({"score": F.expr("(security_id * 7 + ref * 13) % 10 / 10.0D"), "reachable": F.expr("(security_id + ref) % 9 <> 0")})
    return navs.link_decisions(d).withColumn("shown", F.array_join(F.transform("shown", lambda x: x.cast("string")), ","))
