"""What of a price series is still to be fetched, what a fetch covered, and the price that stands now.

A range counts as covered only after a fetch said so; a day without a price in a covered range is no session, one outside is unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import first_day, last_day, merged_ranges, packed_ranges

SERIES = ["source", "ref"]
#: Sources of which the last stored price is the price; sources whose whole history comes at once, so once a day.
STORED, ONCE = ("fund", "manual"), ("fund",)
#: Seconds for which a price that was asked for stands; grams in a troy ounce; days before a stretch from which a rate is carried on.
FRESH, OUNCE, CARRY = 300, 31.1034768, 7


def gaps(requests: DataFrame, covered: DataFrame) -> DataFrame:
    """source, ref, gap_start, gap_end: what covered ranges (source, ref, start_date, end_date) leave of the requested ones (the same columns).

    Requests of a series that overlap or touch are one; a series without a covered range is one gap.
    """
    want = packed_ranges(requests, SERIES).select(*SERIES, F.explode("ranges").alias("_want"))
    have = packed_ranges(covered, SERIES).withColumnRenamed("ranges", "_have")
    lo, hi = first_day(F.col("_want")), last_day(F.col("_want"))
    inside = F.filter(F.coalesce("_have", F.array().cast("array<long>")), lambda x: (last_day(x) >= lo) & (first_day(x) <= hi))
    # a gap goes from the end of one covered range to the start of the next
    ends = F.concat(F.transform(inside, lambda x: first_day(x) - 1), F.array(hi))
    starts = F.concat(F.array(lo), F.transform(inside, lambda x: last_day(x) + 1))
    gap = F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: x["a"] <= x["b"])
    d = want.join(have, SERIES, "left").select(*SERIES, F.explode(gap).alias("_gap"))
    return d.select(*SERIES, F.date_from_unix_date("_gap.a").alias("gap_start"), F.date_from_unix_date("_gap.b").alias("gap_end"))


def fetch_plan(requests: DataFrame, covered: DataFrame, attempts: DataFrame, today: Column, once: tuple[str, ...] = ONCE) -> DataFrame:
    """The gaps that are worth a fetch today.

    attempts: source, ref, attempted_on, ok. A series that was tried today without success isn't tried again; one of a source in
    `once` not after success either. Of such a source the whole stretch of its gaps is one fetch.
    """
    tried = attempts.where(F.col("attempted_on") == today).where(~F.col("ok") | F.col("source").isin(*once)).select(*SERIES).distinct()
    g = gaps(requests, covered).join(tried, SERIES, "left_anti")
    whole = F.when(F.col("source").isin(*once), F.lit("0001-01-01").cast("date")).otherwise(F.col("gap_start"))
    return g.groupBy(*SERIES, whole.alias("_one")).agg(F.min("gap_start").alias("gap_start"), F.max("gap_end").alias("gap_end")).drop("_one")


def recorded(covered: DataFrame, attempts: DataFrame, plan: DataFrame, results: DataFrame, today: Column) -> tuple[DataFrame, DataFrame]:
    """(covered, attempts) after the plan's fetches: ranges grow by what results cover (source, ref, start_date, end_date), every planned
    series has an attempt of today, which succeeded if anything was covered. A planned series without a result has failed.
    """
    r = results.where("start_date <= end_date").select(*SERIES, "start_date", "end_date")
    ranges = merged_ranges(covered.select(*SERIES, "start_date", "end_date").unionByName(r), SERIES)
    tried = plan.select(*SERIES).distinct()
    done = tried.join(r.select(*SERIES).distinct().withColumn("ok", F.lit(True)), SERIES, "left").select(*SERIES, today.alias("attempted_on"), F.coalesce("ok", F.lit(False)).alias("ok"))
    return ranges, attempts.select(*SERIES, "attempted_on", "ok").join(tried, SERIES, "left_anti").unionByName(done)


def composable(wanted: DataFrame, covered: DataFrame, futures: DataFrame, rates: DataFrame, carry: int = CARRY) -> DataFrame:
    """wanted (ref, future, currency, gap_start, gap_end) with ready and composed: may a gap of a composed series be called covered?

    Both parts must be covered in it (covered: source 'future' or 'fx', ref, start_date, end_date), and every day of a future's price must
    have a rate on it or before (futures: ref, date; rates: ref, date), from `carry` days before the series' first gap on. composed: days with both.
    """
    g = wanted.withColumn("_id", F.concat_ws("|", "ref", "gap_start", "gap_end"))
    need = lambda source, ref: g.select(F.lit(source).alias("source"), F.col(ref).alias("ref"), F.col("gap_start").alias("start_date"), F.col("gap_end").alias("end_date"), "_id")
    have = merged_ranges(covered, SERIES)
    part = need("future", "future").unionByName(need("fx", "currency")).join(have.withColumnsRenamed({"start_date": "_s", "end_date": "_e"}), SERIES, "left")
    part = part.groupBy("_id", "source").agg(F.max(F.coalesce((F.col("_s") <= F.col("start_date")) & (F.col("end_date") <= F.col("_e")), F.lit(False))).alias("whole"))
    both = part.groupBy("_id").agg(F.min("whole").alias("_whole"))
    # days meet gaps month by month
    month = lambda c: F.trunc(c, "MM")
    m = g.withColumn("_m", F.explode(F.sequence(month("gap_start"), month("gap_end"), F.expr("interval 1 month"))))
    f = futures.select(F.col("ref").alias("future"), F.col("date").alias("_d"), month("date").alias("_m"))
    days = m.join(f, ["future", "_m"]).where("_d between gap_start and gap_end").groupBy("_id").agg(F.min("_d").alias("_first"), F.count("*").alias("_days"))
    span = g.groupBy("ref", "currency").agg(F.date_sub(F.min("gap_start"), carry).alias("_from"), F.max("gap_end").alias("_to"))
    span = span.withColumn("_m", F.explode(F.sequence(month("_from"), month("_to"), F.expr("interval 1 month"))))
    r = rates.select(F.col("ref").alias("currency"), F.col("date").alias("_r"), month("date").alias("_m"))
    first_rate = span.join(r, ["currency", "_m"]).where("_r between _from and _to").groupBy("ref", "currency").agg(F.min("_r").alias("_rate"))
    without = m.join(first_rate, ["ref", "currency"]).join(f, ["future", "_m"]).where("_d between gap_start and gap_end and _d < _rate").groupBy("_id").agg(F.count("*").alias("_without"))
    d = g.join(both, "_id", "left").join(days, "_id", "left").join(first_rate, ["ref", "currency"], "left").join(without, "_id", "left")
    composed = F.when(F.col("_rate").isNull(), 0).otherwise(F.coalesce("_days", F.lit(0)) - F.coalesce("_without", F.lit(0)))
    return d.withColumn("composed", composed.cast("long")).withColumn("ready", F.col("_whole") & (F.col("composed") == F.coalesce("_days", F.lit(0)))).select(*wanted.columns, "ready", "composed")


def _latest(daily: DataFrame) -> DataFrame:
    return daily.groupBy(*SERIES).agg(F.max_by(F.struct("price", "currency"), "date").alias("_last"))


def source_spots(series: DataFrame, daily: DataFrame, cache: DataFrame, quotes: DataFrame, now: float, fresh: int = FRESH) -> DataFrame:
    """source, ref, price, currency, origin of every series (source, ref): the price that stands now, null where there is none.

    stored: sources whose last daily price is the price; cache: a price asked for at most `fresh` seconds ago (cache:
    source, ref, price, currency, fetched_at); quote: what the source answers now (quotes: source, ref, price, currency; no
    row or a null price: no answer); fallback: without an answer the last daily price (daily: source, ref, date, price, currency).
    """
    one = lambda d, name: d.select(*SERIES, F.struct("price", F.coalesce("currency", F.lit("JPY")).alias("currency")).alias(name))
    d = series.select(*SERIES).distinct().join(_latest(daily), SERIES, "left").join(one(cache.where(F.lit(now) - F.col("fetched_at") <= fresh), "_cached"), SERIES, "left").join(one(quotes.where("price is not null"), "_quote"), SERIES, "left")
    stored = F.col("source").isin(*STORED)
    origin = F.when(stored & F.col("_last").isNotNull(), "stored").when(stored, None).when(F.col("_cached").isNotNull(), "cache").when(F.col("_quote").isNotNull(), "quote").when(F.col("_last").isNotNull(), "fallback")
    x = F.when(F.col("origin").isin("stored", "fallback"), F.struct("_last.price", F.coalesce("_last.currency", F.lit("JPY")).alias("currency"))).when(F.col("origin") == "cache", F.col("_cached")).when(F.col("origin") == "quote", F.col("_quote"))
    return d.withColumn("origin", origin).withColumn("_x", x).select(*SERIES, "_x.price", "_x.currency", "origin")


def metal_quotes(metals: DataFrame, spots: DataFrame) -> DataFrame:
    """source 'metal', ref, price, currency: a gram in the base currency from the future's price of an ounce and the dollar's rate.

    metals: ref, future; spots as of source_spots. No row where either is missing.
    """
    f = spots.where("source = 'future' and price is not null").select(F.col("ref").alias("future"), F.col("price").alias("_f"))
    usd = spots.where("source = 'fx' and ref = 'USD' and price is not null").select(F.col("price").alias("_r"))  # one row
    return metals.join(f, "future").join(F.broadcast(usd)).select(F.lit("metal").alias("source"), "ref", (F.col("_f") * F.col("_r") / OUNCE).alias("price"), F.lit("JPY").alias("currency"))


def index_at(points: DataFrame, lookups: DataFrame) -> DataFrame:
    """lookups (ref, day) with level: the monthly index (ref, date, level) on a day, linear between points, null before the first, constant after the last; levels of 0 and less are no points."""
    p = points.where("level > 0")
    d = lookups.select("ref", "day").distinct().join(p, "ref", "left").groupBy("ref", "day").agg(
        F.max_by(F.struct("date", "level"), F.when(F.col("date") <= F.col("day"), F.col("date"))).alias("a"), F.min_by(F.struct("date", "level"), F.when(F.col("date") > F.col("day"), F.col("date"))).alias("b")
    )
    share = F.datediff("day", "a.date") / F.datediff("b.date", "a.date")
    level = F.when(F.col("a.level").isNotNull(), F.when(F.col("b.level").isNull(), F.col("a.level").cast("double")).otherwise(F.col("a.level") + (F.col("b.level") - F.col("a.level")) * share))
    return lookups.join(d.select("ref", "day", level.alias("level")), ["ref", "day"], "left")


def extended(appraisals: DataFrame, index: DataFrame, today: Column) -> DataFrame:
    """security_id, value, indexed: appraisals (security_id, index_ref, date, price) brought to today by an index (ref, date, level).

    After the last appraisal, and before the first, that one by the index's ratio (as it stands where the index isn't known on both days).
    Between two it follows the index and meets both, the drift spread over the days; it is linear where the index is unknown.
    """
    one = F.struct(F.col("date"), F.col("price").cast("double").alias("price"))
    a = appraisals.groupBy("security_id", "index_ref").agg(F.max_by(one, F.when(F.col("date") <= today, F.col("date"))).alias("a"), F.min_by(one, F.when(F.col("date") > today, F.col("date"))).alias("b"))
    a = a.withColumn("_today", today)
    days = a.select(F.col("index_ref").alias("ref"), F.explode(F.array_compact(F.array("_today", "a.date", "b.date"))).alias("day")).distinct()
    levels = index_at(index, days)
    at = lambda name, day: levels.select(F.col("ref").alias("index_ref"), F.col("day").alias(f"_{name}_day"), F.col("level").alias(name))
    d = a.withColumns({"_iu_day": F.col("_today"), "_ia_day": F.col("a.date"), "_ib_day": F.col("b.date")})
    for name in ("iu", "ia", "ib"):
        d = d.join(at(name, f"_{name}_day"), ["index_ref", f"_{name}_day"], "left")
    va, vb, ia, ib, iu = (F.col(c) for c in ("a.price", "b.price", "ia", "ib", "iu"))
    scaled = lambda v, i: F.when(i.isNotNull() & iu.isNotNull(), v * iu / i).otherwise(v)
    share = F.datediff("_today", "a.date") / F.datediff("b.date", "a.date")
    between = F.when(ia.isNotNull() & ib.isNotNull() & iu.isNotNull(), va * iu / ia + (vb - va * ib / ia) * share).otherwise(va + (vb - va) * share)
    value = F.when(va.isNull(), scaled(vb, ib)).when(vb.isNull(), scaled(va, ia)).otherwise(between)
    known = iu.isNotNull() & (va.isNull() | ia.isNotNull()) & (vb.isNull() | ib.isNotNull())
    return d.select("security_id", value.alias("value"), known.alias("indexed"))


def security_spots(securities: DataFrame, spots: DataFrame, manual: DataFrame) -> DataFrame:
    """security_id, price, price_currency, origin, warnings of every security that has a source.

    securities: security_id, currency, status ('linked', 'manual', ...), source, ref, inactive. Manual ones go by their own id
    and by their appraisals brought to today (manual: security_id, value, indexed) where there is an index; inactive ones and those
    without a source have no row. warnings: no price, last close, currency.
    """
    s = securities.where(~F.coalesce("inactive", F.lit(False)))
    by_hand = F.coalesce((F.col("status") == "manual") | (F.col("source") == "manual"), F.lit(False))
    linked = (F.col("status") == "linked") & (F.col("source") != "none") & (F.col("ref") != "")
    s = s.where(by_hand | linked).withColumns({"source": F.when(by_hand, "manual").otherwise(F.col("source")), "ref": F.when(by_hand, F.col("security_id").cast("string")).otherwise(F.col("ref"))})
    p = spots.select(*SERIES, "price", F.col("currency").alias("price_currency"), "origin")
    d = s.join(p, SERIES, "left").join(manual.select("security_id", "value", "indexed"), "security_id", "left")
    grown = (F.col("source") == "manual") & F.col("value").isNotNull() & F.col("price").isNotNull()
    doubts = F.array_compact(F.array(F.when(F.col("price").isNull(), "no price"), F.when(F.col("origin") == "fallback", "last close"), F.when(F.col("price_currency") != F.col("currency"), "currency")))
    return d.select("security_id", F.when(grown, F.col("value")).otherwise(F.col("price").cast("double")).alias("price"), "price_currency", F.when(grown & F.col("indexed"), "index").otherwise(F.col("origin")).alias("origin"), doubts.alias("warnings"))
