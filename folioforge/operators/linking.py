"""Names of a statement that no security is known for: one entry a name, one group a code, and what each is linked with.

Evidence in order: a code that the file resolves elsewhere, prices of the day, what the account holds, an equal quantity.
Names and codes are rows, so a name with very many rows or codes is summed up before it moves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import security_code
from ..sources.scratch import written
from .matching import code_components, unique_matches

CASH = ("cash_in", "cash_out")
#: Types whose unit price isn't the market's.
OTHER_PRICES = ("transfer_in", "transfer_out", "dividend", "return_of_capital", "split", *CASH)
#: Days that must agree; days from which a share of them is enough; that share; days ahead to the next session; likeness from which a name speaks for itself.
SURE_DAYS, MANY_DAYS, SHARE, SESSION, ALIKE = 3, 20, 0.9, 4, 0.5
#: Words of a fund's class and region (fixed values): a fund doesn't change them with its name.
CLASSES = (("株式",), ("債券",), ("リート", "reit"), ("バランス",))
REGIONS = (("国内", "日本"), ("先進国",), ("新興国",), ("全世界", "オールカントリー"), ("米国",), ("中国", "チャイナ"))


def code_keys(code: Column) -> Column:
    """The forms that a code may stand in: itself, the digits inside an old form of nine, the short exchange form; empty for a blank one."""
    c = F.trim(code)
    old = F.when(c.rlike("^0[0-9]{4}0000$"), F.substring(c, 2, 4))
    return F.array_distinct(F.array_compact(F.array(F.when(c != "", c), old, security_code(c))))


def _open(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("security_id").isNull() & (F.col("name") != "") & ~F.col("kind").isin(*CASH) & ~F.coalesce("margin", F.lit(False)))


def entries(rows: DataFrame) -> DataFrame:
    """name, rows, undetermined, net_quantity, first_date, last_date of every name without a security.

    rows: name, code, security_id (null: not resolved), kind, margin, still (nothing moves), quantity (signed), trade_date. Cash,
    margin trades and rows in which nothing moves don't count; nor does the quantity of a row of unknown type (undetermined).
    """
    other = F.col("kind") == "other"
    return _open(rows).where("not still").groupBy("name").agg(
        F.count("*").alias("rows"), F.count_if(other).alias("undetermined"), F.coalesce(F.sum(F.when(~other, F.col("quantity"))), F.lit(0.0)).alias("net_quantity"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date")
    )


def name_keys(rows: DataFrame) -> DataFrame:
    """name, key: every form of the codes that stand beside a name that has an entry; rows in which nothing moves count, as they tell of renamings."""
    moving = _open(rows).where("not still").select("name").distinct()
    return _open(rows).select("name", F.explode(code_keys(F.col("code"))).alias("key")).distinct().join(moving, "name", "left_semi")


def merged_by_code(found: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: name, group; groups: group, names, and the entries' columns summed): names that share codes, directly or through others.

    A group is called by the name that was traded last (ties: the smallest).
    """
    parts = code_components(keys.select(F.col("name").alias("entity"), F.col("key").alias("code"))).select(F.col("entity").alias("name"), "component")
    d = written(found.join(parts, "name", "left").withColumn("component", F.coalesce("component", "name")), "names")
    last = F.struct(F.col("last_date").isNull(), -F.unix_date("last_date"), "name")
    g = d.groupBy("component").agg(
        F.min_by("name", last).alias("group"), F.count("*").alias("names"), F.sum("rows").alias("rows"), F.sum("undetermined").alias("undetermined"), F.sum("net_quantity").alias("net_quantity"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date")
    )
    g = written(g, "groups")
    return d.join(g.select("component", "group"), "component").select("name", "group"), g.drop("component")


def resolved_keys(rows: DataFrame, order: str) -> DataFrame:
    """key, security_id: what the file's resolved codes stand for; of several the first by order."""
    d = rows.where(F.col("security_id").isNotNull() & (F.col("name") != "") & ~F.col("kind").isin(*CASH))
    return d.select(F.explode(code_keys(F.col("code"))).alias("key"), "security_id", order).groupBy("key").agg(F.min_by("security_id", F.struct(order, "security_id")).alias("security_id"))


def market_prices(rows: DataFrame, members: DataFrame) -> DataFrame:
    """group, trade_date, unit_price, n: the market prices of each group's rows, equal ones once with their number."""
    d = _open(rows).where(~F.col("still") & ~F.col("kind").isin(*OTHER_PRICES) & ~F.coalesce("off_market", F.lit(False)) & F.col("trade_date").isNotNull() & (F.col("unit_price") != 0))
    return d.join(members, "name").groupBy("group", "trade_date", "unit_price").agg(F.count("*").alias("n"))


def weighed(candidates: DataFrame, prices: DataFrame, series: DataFrame, unit: float = 1.0, days: int = SESSION) -> DataFrame:
    """candidates (group, security_id, ...) with checked, matched, shifted: do a group's prices agree with a candidate's?

    Each price may be the day's or, within `days`, the next session's, to a unit of its last digit; days without either
    aren't checked. shifted: some agreed with the next session only. series: security_id, date, price. Prices and series
    meet month by month, once for each candidate.
    """
    month = lambda c: F.trunc(c, "MM")
    p = candidates.select("group", "security_id").distinct().join(prices, "group").withColumn("_m", F.explode(F.sequence(month("trade_date"), month(F.date_add("trade_date", days)), F.expr("interval 1 month"))))
    s = series.select("security_id", F.col("date").alias("_d"), F.col("price").alias("_p"), month("date").alias("_m"))
    near = p.join(s, ["security_id", "_m"]).where((F.col("_d") >= F.col("trade_date")) & (F.col("_d") <= F.date_add("trade_date", days)))
    later = F.col("_d") > F.col("trade_date")
    d = near.groupBy("group", "security_id", "trade_date", "unit_price", "n").agg(F.max(F.when(~later, F.col("_p"))).alias("same"), F.min_by(F.col("_p"), F.when(later, F.col("_d"))).alias("next"))
    fits = lambda c: F.coalesce(F.abs(F.col(c) - F.col("unit_price")) <= unit, F.lit(False))
    count = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    g = d.groupBy("group", "security_id").agg(F.sum("n").alias("checked"), count(fits("same") | fits("next")).alias("matched"), F.max(~fits("same") & fits("next")).alias("shifted"))
    none = F.lit(0).cast("long")
    return written(candidates.join(g, ["group", "security_id"], "left").withColumns({"checked": F.coalesce("checked", none), "matched": F.coalesce("matched", none), "shifted": F.coalesce("shifted", F.lit(False))}), "weighed")


def verdict() -> Column:
    """match, partial or mismatch by prices; unknown where none could be checked."""
    return F.when(F.col("checked") == 0, "unknown").when(F.col("matched") == F.col("checked"), "match").when(F.col("matched") > 0, "partial").otherwise("mismatch")


def confirmed() -> Column:
    """Prices speak for a candidate: all of at least three, or nearly all of very many."""
    return (F.col("matched") >= SURE_DAYS) & ((F.col("matched") == F.col("checked")) | ((F.col("checked") >= MANY_DAYS) & (F.col("matched") >= SHARE * F.col("checked"))))


def _bucket(name: Column, groups: tuple[tuple[str, ...], ...]) -> Column:
    """The one group that a name has words of; null for none and for several."""
    hit = [reduce(lambda a, b: a | b, [F.contains(name, F.lit(w)) for w in g]) for g in groups]
    n = reduce(lambda a, b: a + b, [h.cast("int") for h in hit])
    return F.when(n == 1, reduce(lambda a, b: a + b, [F.when(h, i).otherwise(0) for i, h in enumerate(hit)]))


def category_conflict(a: Column, b: Column) -> Column:
    """Do two comparable names (see names.comparable_name) say different classes or regions? A name that says several or none tells nothing."""
    differ = lambda groups: F.coalesce(_bucket(a, groups) != _bucket(b, groups), F.lit(False))
    return differ(CLASSES) | differ(REGIONS)


def refuted(candidate: str = "comparable", name: str = "group_comparable", refined: str = "refined") -> Column:
    """What speaks against a candidate whose prices say nothing: category, name, or null."""
    unknown = F.col("checked") == 0
    return F.when(unknown & category_conflict(F.col(name), F.col(candidate)), "category").when(unknown & (F.col(refined) < ALIKE), "name")


def decided(groups: DataFrame, members: DataFrame, keys: DataFrame, resolved: DataFrame, candidates: DataFrame, held: DataFrame, holdings: DataFrame, explained: DataFrame) -> DataFrame:
    """group, security_id, how: what every group is linked with (null: nothing).

    code: all of its codes that the file resolves stand for one security; price: prices confirm one candidate (candidates: group,
    security_id, checked, matched); account: of several, the account holds one (held: security_id); quantity: its net
    quantity is that of one holding that nothing explains (holdings: security_id, quantity; explained: security_id),
    and of no other group without a link; ambiguous: prices confirm several; none.
    """
    own = keys.join(members, "name").select("group", "key").distinct()
    code = own.join(resolved, "key").groupBy("group").agg(F.min("security_id").alias("by_code"), F.max("security_id").alias("_top")).where("by_code = _top").drop("_top")
    mine = held.select("security_id").distinct().withColumn("_held", F.lit(True))
    sure = candidates.where(confirmed()).select("group", "security_id").distinct().join(mine, "security_id", "left")
    here = F.when(F.col("_held"), F.col("security_id"))
    price = sure.groupBy("group").agg(F.count("*").alias("sure"), F.min("security_id").alias("one"), F.count(here).alias("here"), F.min(here).alias("one_here"))
    d = written(groups.join(code, "group", "left").join(price, "group", "left"), "evidence")
    how = F.when(F.col("by_code").isNotNull(), "code").when(F.col("sure") == 1, "price").when((F.col("sure") > 1) & (F.col("here") == 1), "account").when(F.col("sure") > 1, "ambiguous").otherwise("none")
    d = d.withColumn("how", how).withColumn("security_id", F.when(F.col("how") == "code", F.col("by_code")).when(F.col("how") == "price", F.col("one")).when(F.col("how") == "account", F.col("one_here")))
    known = explained.select("security_id").unionByName(d.where("security_id is not null").select("security_id")).distinct()
    left = d.where("security_id is null and undetermined = 0 and net_quantity > 0").select("group", F.col("net_quantity").alias("quantity"))
    right = holdings.select(F.col("security_id").alias("by_quantity"), F.col("quantity").cast("double").alias("quantity")).join(known, F.col("by_quantity") == F.col("security_id"), "left_anti")
    d = d.join(unique_matches(left, right, ["quantity"]).select("group", "by_quantity"), "group", "left")
    return written(d.select("group", F.coalesce("security_id", "by_quantity").alias("security_id"), F.when(F.col("by_quantity").isNotNull(), "quantity").otherwise(F.col("how")).alias("how")), "links")


def live(candidates: DataFrame, links: DataFrame, members: DataFrame, keys: DataFrame, resolved: DataFrame) -> DataFrame:
    """candidates (with refuted, comparable names and a code) with verdict and against: what speaks against each, null for a live one.

    price: prices say no; category and name as refuted(); code: prices say nothing, and the candidate appears in the file, or is known, by
    codes of which the group has none (links: group, security_id; groups with a link or without a code aren't judged by it).
    """
    own = keys.join(members, "name").select("group", "key").distinct()
    of = resolved.select("security_id", "key").unionByName(own.join(links.where("security_id is not null").select("group", "security_id"), "group").select("security_id", "key"))
    of = of.unionByName(candidates.select("security_id", F.explode(code_keys(F.col("code"))).alias("key"))).distinct()
    pairs = candidates.select("group", "security_id").distinct()
    common = pairs.join(own, "group").join(of, ["security_id", "key"]).select("group", "security_id").distinct().withColumn("_common", F.lit(True))
    has_own = own.select("group").distinct().join(links.where("security_id is not null").select("group"), "group", "left_anti").withColumn("_own", F.lit(True))
    has_of = of.select("security_id").distinct().withColumn("_of", F.lit(True))
    d = candidates.join(common, ["group", "security_id"], "left").join(has_own, "group", "left").join(has_of, "security_id", "left")
    apart = (F.col("checked") == 0) & F.coalesce("_own", F.lit(False)) & F.coalesce("_of", F.lit(False)) & F.col("_common").isNull()
    against = F.when(verdict() == "mismatch", "price").otherwise(F.coalesce(F.col("refuted"), F.when(apart, "code")))
    return d.withColumns({"verdict": verdict(), "against": against}).drop("_common", "_own", "_of", "refuted")


def outlook(groups: DataFrame, links: DataFrame, candidates: DataFrame) -> DataFrame:
    """groups with how, security_id, live (candidates that nothing speaks against) and state: what a user has to do about each.

    linked; choose (some candidate is live); sold (nothing is left and all types are known: may be made anew); unclear (a type is
    unknown); still held (a balance is left, so it must not be made anew).
    """
    n = candidates.groupBy("group").agg(F.count_if(F.col("against").isNull()).alias("live"))
    d = groups.join(links, "group").join(n, "group", "left").withColumn("live", F.coalesce("live", F.lit(0).cast("long")))
    state = F.when(F.col("security_id").isNotNull(), "linked").when(F.col("live") > 0, "choose").when(F.col("undetermined") > 0, "unclear").when(F.col("net_quantity") == 0, "sold").otherwise("still held")
    return d.withColumn("state", state)


def closed_securities(rows: DataFrame, order: str, known: tuple[str, ...] = ()) -> DataFrame:
    """name, code, asset_class, unit, divisor, currency of securities that were sold, from their rows: what may be made anew, out of use.

    The code is the first valid one by order; the divisor (1 or 10,000) that for which more rows' quantity x price makes the amount (gross,
    else net), ties 1; the currency the most frequent (missing: base), ties that which came first. With a code it is a
    share, by 10,000 a fund, else other.
    """
    amount = F.abs(F.when(F.col("gross") != 0, F.col("gross")).otherwise(F.col("net")))
    q, p = F.abs(F.col("quantity")), F.abs(F.col("unit_price"))
    hit = lambda by: F.count_if((q != 0) & (p != 0) & (amount != 0) & (F.abs(q * p / by - amount) <= 1 + q * 0.5 / by))
    d = rows.withColumn("_code", security_code(F.col("code"), known)).withColumn("_currency", F.coalesce(F.when(F.col("currency") != "", F.col("currency")), F.lit("JPY")))
    per = d.groupBy("name", "_currency").agg(F.count("*").alias("n"), F.min(order).alias("at"), hit(1).alias("one"), hit(10_000).alias("many"), F.min_by("_code", F.when(F.col("_code").isNotNull(), F.col(order))).alias("_code"), F.min(F.when(F.col("_code").isNotNull(), F.col(order))).alias("code_at"))
    g = per.groupBy("name").agg(F.min_by("_code", "code_at").alias("code"), F.when(F.sum("many") > F.sum("one"), 10_000).otherwise(1).alias("divisor"), F.min_by("_currency", F.struct(-F.col("n"), "at")).alias("currency"))
    fund = F.col("divisor") == 10_000
    asset_class = F.when(F.col("code").isNotNull(), "stock").when(fund, "fund").otherwise("other")
    return g.select("name", "code", asset_class.alias("asset_class"), F.when(F.col("code").isNull() & fund, "unit").otherwise("share").alias("unit"), "divisor", "currency")
