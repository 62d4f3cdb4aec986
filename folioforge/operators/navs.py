"""Funds by their published prices: is a candidate the fund of a statement, and how many units is a value.

Prices are looked up in a stretch of days before a statement. Statement and prices meet month by month, and what a
statement sees of a series is at most its days, so all pairs of two stretches are weighed inside a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Days back for a reported price and for values of pensions; pairs of statements that are checked; what a movement may be off.
PRICE_DAYS, VALUE_DAYS, PAIRS, SHARE, LEAST = 7, 14, 6, 0.005, 10.0
#: Units that a published price is for.
PER = 10_000


def _month(day: Column) -> Column:
    return F.trunc(day, "MM")


def seen(lookups: DataFrame, series: DataFrame, day: str, days: int, prices: str) -> DataFrame:
    """lookups (id, ref, day, ...) with prices: array of (date, nav) of the series (ref, date, nav) in the days up to the day, oldest first; empty if none."""
    m = lookups.select("id", "ref", F.col(day).alias("_day")).withColumn("_m", F.explode(F.sequence(_month(F.date_sub("_day", days)), _month(F.col("_day")), F.expr("interval 1 month"))))
    s = series.select("ref", F.col("date").alias("_date"), F.col("nav").alias("_nav"), _month(F.col("date")).alias("_m"))
    near = m.join(s, ["ref", "_m"]).where((F.col("_date") >= F.date_sub("_day", days)) & (F.col("_date") <= F.col("_day")))
    found = near.groupBy("id", "ref").agg(F.sort_array(F.collect_list(F.struct(F.col("_date").alias("date"), F.col("_nav").alias("nav")))).alias(prices))
    return lookups.join(found, ["id", "ref"], "left").withColumn(prices, F.coalesce(prices, F.array().cast(found.schema[prices].dataType)))


def verified(reports: DataFrame, series: DataFrame, days: int = PRICE_DAYS) -> DataFrame:
    """id, ref, matched, matched_on, latest: does a candidate series (ref) have exactly the reported price within `days` up to as_of?

    reports: id, ref, as_of, reported. matched_on is the latest such day; latest the last price in the stretch, null
    without one. A null reported price matches nothing.
    """
    d = seen(reports, series, "as_of", days, "prices")
    hits = F.filter("prices", lambda p: p["nav"] == F.col("reported"))
    return d.select("id", "ref", (F.size(hits) > 0).alias("matched"), F.try_element_at(hits, F.lit(-1))["date"].alias("matched_on"), F.try_element_at("prices", F.lit(-1))["nav"].alias("latest"))


def value_pairs(statements: DataFrame, last: int = PAIRS) -> DataFrame:
    """security_id, pair, t1, v1, c1, t2, v2, c2: a security's last pairs of statements after each other, of each lot.

    statements: account_id, security_id, lot_seq, as_of_date, quantity, value, cost. Rows with no quantity or value don't
    count; pairs without both costs are left out. Pairs are numbered from the latest.
    """
    w = Window.partitionBy("account_id", "security_id", "lot_seq").orderBy("as_of_date")
    d = statements.where("quantity <> 0 and value is not null").withColumn("_next", F.lead(F.struct("as_of_date", "value", "cost")).over(w))
    d = d.where(F.col("_next").isNotNull() & F.col("cost").isNotNull() & F.col("_next.cost").isNotNull() & (F.col("as_of_date") != F.col("_next.as_of_date")))
    d = d.select("security_id", F.col("as_of_date").alias("t1"), F.col("value").alias("v1"), F.col("cost").alias("c1"), F.col("_next.as_of_date").alias("t2"), F.col("_next.value").alias("v2"), F.col("_next.cost").alias("c2"), "account_id", "lot_seq")
    rank = Window.partitionBy("security_id").orderBy(F.desc("t2"), F.desc("account_id"), F.desc("lot_seq"))
    return d.withColumn("pair", F.row_number().over(rank)).where(F.col("pair") <= last).drop("account_id", "lot_seq")


def movement_checked(pairs: DataFrame, candidates: DataFrame, series: DataFrame, days: int = VALUE_DAYS) -> DataFrame:
    """security_id, ref, explained, checked, worst: do a candidate's prices explain how values moved between statements?

    The value before x price after / price before + what was paid in should be the value after, for the best choice of
    a day up to each statement; all pairs that have prices must pass. explained is null where none has. worst is the
    largest error as a share of what is allowed.
    """
    d = pairs.join(candidates.select("security_id", "ref"), "security_id").withColumn("id", F.concat_ws("-", "security_id", "pair"))
    d = seen(seen(d, series, "t1", days, "before"), series, "t2", days, "after")
    v1, v2, paid = (F.col(c).cast("double") for c in ("v1", "v2", "paid"))
    d = d.withColumn("paid", F.col("c2") - F.col("c1"))
    errors = F.flatten(F.transform(F.filter("before", lambda p: p["nav"] != 0), lambda b: F.transform("after", lambda a: F.abs(v1 * a["nav"] / b["nav"] + paid - v2))))
    d = d.withColumn("error", F.array_min(errors)).withColumn("allowed", F.greatest(v2 * SHARE, F.lit(LEAST)))
    checked = F.when((F.size("before") > 0) & (F.size("after") > 0) & (v2 != 0), F.col("error"))
    g = d.withColumn("error", checked).groupBy("security_id", "ref").agg(F.count("error").alias("checked"), F.count_if(F.col("error") <= F.col("allowed")).alias("passed"), F.max(F.col("error") / F.col("allowed")).alias("worst"))
    return g.select("security_id", "ref", F.when(F.col("checked") > 0, F.col("checked") == F.col("passed")).alias("explained"), "checked", "worst")


def units(value: Column, nav: Column, per: int = PER) -> Column:
    """Whole units that a value is nearest to, halves up; value and nav are whole numbers of the same small unit."""
    up = 2 * value * per + nav
    return ((up - F.pmod(up, 2 * nav)).cast("decimal(38,0)") / (2 * nav)).cast("long")


def derived_units(statements: DataFrame, series: DataFrame, days: int = VALUE_DAYS, per: int = PER, money: int = 100) -> DataFrame:
    """statements (ref, as_of, value, ...) with units and exact.

    Values and prices are whole cents (money of them are one). The newest of the `days` up to the series' last price by as_of
    under whose price whole units make the value to less than one is exact; else the newest price gives a share with four
    digits. Null for values that are not positive and series without a price by then.
    """
    prices = series.where("nav > 0").select("ref", "date", "nav")
    # the last price by as_of: a series as stretches from one price to the next, which meet statements month by month
    spans = series.select("ref", F.col("date").alias("_d"), F.lead("date").over(Window.partitionBy("ref").orderBy("date")).alias("_n")).where("_n is not null")
    spans = spans.withColumn("_m", F.explode(F.sequence(_month(F.col("_d")), _month(F.col("_n")), F.expr("interval 1 month"))))
    # what a day sees of a series is looked up once, however many statements there are on it
    at = statements.select("ref", "as_of").distinct()
    inside = at.withColumn("_m", _month(F.col("as_of"))).join(spans, ["ref", "_m"]).where((F.col("_d") <= F.col("as_of")) & (F.col("_n") > F.col("as_of"))).groupBy("ref", "as_of").agg(F.max("_d").alias("last"))
    ends = series.groupBy("ref").agg(F.max("date").alias("_end"))
    at = at.join(inside, ["ref", "as_of"], "left").join(ends, "ref", "left").select("ref", F.col("as_of").alias("id"), F.coalesce("last", F.when(F.col("_end") <= F.col("as_of"), F.col("_end"))).alias("last"))
    at = written(seen(at, prices, "last", days, "_prices").select("ref", F.col("id").alias("as_of"), "_prices"), "prices-seen")
    d = statements.join(at, ["ref", "as_of"], "left")
    value = F.col("value")
    newest = F.reverse("_prices")
    fits = F.filter(F.transform(newest, lambda p: F.struct(p["nav"].alias("nav"), units(value, p["nav"], per).alias("units"))), lambda u: (u["units"] >= 1) & (F.abs(u["units"] * u["nav"] - value * per) < money * per))
    share = F.bround((value * per).cast("decimal(38,0)") / F.try_element_at(newest, F.lit(1))["nav"], 4).cast("double")
    whole = F.try_element_at(fits, F.lit(1))["units"]
    good = value > 0
    return d.select(*statements.columns, F.when(good, F.coalesce(whole.cast("double"), share)).alias("units"), F.when(good & (F.size("_prices") > 0), whole.isNotNull()).alias("exact"))


def rewritten_units(statements: DataFrame, series: DataFrame, manual: DataFrame, **kwargs: int) -> DataFrame:
    """Statements of linked pensions with their quantity in units: account_id, security_id, lot_seq, as_of, ref, quantity, value, with changed and exact.

    A missing value is the last manual one (security_id, date, value) by as_of. Sold lots (quantity 0) stay. A lot that
    has at most one unit gets what its value gives; another one only a whole number that differs. Others stay.
    """
    key = ["account_id", "security_id", "lot_seq", "as_of"]
    m = statements.where("value is null").select("security_id", "as_of").distinct().join(manual.select("security_id", "date", F.col("value").alias("_v")), "security_id").where(F.col("date") <= F.col("as_of"))
    m = m.groupBy("security_id", "as_of").agg(F.max_by("_v", "date").alias("_v"))
    d = statements.join(m, ["security_id", "as_of"], "left").withColumn("_own", F.col("value")).withColumn("value", F.coalesce("value", "_v"))
    d = derived_units(d, series, **kwargs)
    change = (F.col("quantity") != 0) & F.col("units").isNotNull() & ((F.col("quantity") <= 1) | (F.col("exact") & (F.col("units") != F.col("quantity"))))
    return d.select(*key, "ref", F.when(change, F.col("units")).otherwise(F.col("quantity").cast("double")).alias("quantity"), F.col("_own").alias("value"), F.coalesce(change, F.lit(False)).alias("changed"), F.when(change, F.col("exact")).alias("exact"))


#: Likeness from which a price match links by itself, from which a candidate is shown without one, and candidates that are looked at.
LINK, SHOW, CANDIDATES = 0.2, 0.35, 3


def link_decisions(candidates: DataFrame, best: int = CANDIDATES) -> DataFrame:
    """security_id, status, reason, best_ref, shown: what becomes of a fund's candidate series.

    candidates: security_id, ref, score, matched (by price; null: not checked), explained (by movements), reachable (its prices
    could be read). The `best` by score count (ties: smaller ref). auto: exactly one matches by price and its name is
    alike enough; candidates: several match, or some are alike enough or explained by movements; none. shown: refs to
    choose from, price matches first, then by movement, then by score.
    """
    w = Window.partitionBy("security_id").orderBy(F.desc("score"), "ref")
    c = candidates.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= best)
    match, moved = F.coalesce("matched", F.lit(False)), F.coalesce("explained", F.lit(False))
    viable = (F.col("score") >= SHOW) | moved
    one = F.struct((~match).alias("m"), (~moved).alias("x"), (-F.col("score")).alias("s"), F.col("ref"))
    refs = lambda test: F.transform(F.sort_array(F.collect_list(F.when(test, one))), lambda x: x["ref"])
    g = c.groupBy("security_id").agg(
        F.count_if(match).alias("matches"), F.max(F.when(match, F.col("score"))).alias("score"), F.min_by("ref", F.when(match, F.struct(-F.col("score"), "ref"))).alias("ref"), F.count_if(viable).alias("viable"),
        F.max(~F.coalesce("reachable", F.lit(True))).alias("unread"), refs(F.lit(True)).alias("all"), refs(viable).alias("some"),
    )
    auto, several = (F.col("matches") == 1) & (F.col("score") >= LINK), F.col("matches") > 1
    status = F.when(auto, "auto").when(several | (F.col("viable") > 0), "candidates").otherwise("none")
    reason = F.when(auto, "price").when(several, "several prices").when(F.col("unread"), "prices unread").otherwise("no price")
    shown = F.when(auto | several | (F.col("viable") == 0), F.col("all")).otherwise(F.col("some"))
    return g.select("security_id", status.alias("status"), reason.alias("reason"), F.when(auto, F.col("ref")).alias("best_ref"), shown.alias("shown"))
