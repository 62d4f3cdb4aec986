"""Quantities before the first statement: trades undone newest first from a day that a statement fixes.

A day's trades are one affine map q -> alpha * q + beta, folded in pieces; undoing it is q -> (q - beta) / alpha. What
meets per position is one row for each day with a trade, at most the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .replay import NOTHING, PIECE, POSITION
from .steps import quantity_step

#: A transfer's own record in a ledger may lie so many days before and after its day.
RECORD_BEFORE, RECORD_AFTER = 7, 30
CHANGES = "array<struct<day:date,quantity:double>>"
LINKS = "security_id long, from_account long, to_account long, date date, quantity double, absorbed array<string>"


def _change(day: Column, quantity: Column) -> Column:
    return F.struct(day.alias("day"), quantity.alias("quantity"))


def _settled(q: Column) -> Column:
    return F.when(F.abs(q) <= NOTHING, 0.0).otherwise(q)


def day_maps(moves: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, day, alpha, beta: the map of each day's steps (keys, trade_date, mult, delta), in order; null order columns come first."""
    w = Window.partitionBy(*keys, "trade_date").orderBy(*order)
    d = moves.withColumn("_n", F.row_number().over(w)).withColumn("_p", F.floor((F.col("_n") - 1) / PIECE))

    def folded(d: DataFrame, by: list[str], n: str, mult: str, delta: str) -> DataFrame:
        steps = F.sort_array(F.collect_list(F.struct(n, F.col(mult).alias("mult"), F.col(delta).alias("delta"))))
        one = F.struct(F.lit(1.0).alias("alpha"), F.lit(0.0).alias("beta"))
        m = F.aggregate("s", one, lambda a, t: F.struct((a["alpha"] * t["mult"]).alias("alpha"), (a["beta"] * t["mult"] + t["delta"]).alias("beta")))
        return d.groupBy(*by).agg(steps.alias("s")).select(*by, m.alias("m")).select(*by, "m.*")

    pieces = folded(d, [*keys, "trade_date", "_p"], "_n", "mult", "delta")
    return folded(pieces, [*keys, "trade_date"], "_p", "alpha", "beta").withColumnRenamed("trade_date", "day")


def undone(days: Column, held: Column, until: Column) -> Column:
    """struct(q, bad, changes): days (newest first: day, alpha, beta) undone from held; changes: the quantity from each day before `until` on.

    bad: a quantity below zero was met; what follows it is not undone.
    """
    start = F.struct(held.alias("q"), F.lit(False).alias("bad"), F.array().cast(CHANGES).alias("changes"))

    def undo(a: Column, d: Column) -> Column:
        before = (a["q"] - d["beta"]) / d["alpha"]
        seen = F.when(until.isNull() | (d["day"] < until), F.concat(a["changes"], F.array(_change(d["day"], a["q"])))).otherwise(a["changes"])
        return F.when(a["bad"], a).otherwise(F.struct(_settled(before).alias("q"), (before < -NOTHING).alias("bad"), seen.alias("changes")))

    return F.aggregate(days, start, lambda a, d: F.transform(F.array(a), lambda x: undo(x, d))[0], lambda a: F.struct(a["q"].alias("q"), a["bad"].alias("bad"), F.reverse(a["changes"]).alias("changes")))


def _has_record(links: DataFrame, moves: DataFrame, account: str, kind: str) -> DataFrame:
    """The links without a record of the kind in the account's ledger about their day."""
    t = moves.where(F.col("kind") == kind).select(F.col("account_id").alias("_a"), F.col("security_id").alias("_s"), F.col("trade_date").alias("_d"))
    near = (F.col("_d") >= F.date_sub("date", RECORD_BEFORE)) & (F.col("_d") <= F.date_add("date", RECORD_AFTER))
    return links.join(t, (F.col(account) == F.col("_a")) & (F.col("security_id") == F.col("_s")) & near, "left_anti")


def quantity_paths(tx: DataFrame, snapshots: DataFrame, order: list[str], links: DataFrame | None = None, ref: str = "ref") -> DataFrame:
    """account_id, security_id, status, before, opening, changes: what each position held before its first statement.

    tx: account_id, security_id, trade_date, ref, kind, quantity, split_ratio and order; snapshots: account_id,
    security_id, lot_seq, as_of_date, quantity; links: transfers between accounts (see LINKS; absorbed names the trades
    that a link stands for). changes: the quantity from a day on; before the first change it is the opening one, an
    estimate. before: the first statement's day; null where there is none.

    status: traced (undone from the first statement of a day without trades, else from the first), linked (only
    transfers in are known), closed (no statement: undone from nothing held), and without a path no_snapshot (still
    held by its trades), no_trades, no_earlier_trades, lots_differ (lots start on different days), inconsistent (a
    quantity below zero). Positions of either table have a row; empty tables give none.
    """
    spark, keys, order = tx.sparkSession, POSITION, [c for c in order if c != "trade_date"]
    # where() says to the optimizer that there are none, so that joins with them go
    links = links if links is not None else spark.createDataFrame([], LINKS).where(F.lit(False))
    s = quantity_step()
    moves = tx.withColumn("_s", s).where("_s is not null").join(links.select(F.explode("absorbed").alias(ref)).distinct(), ref, "left_anti")
    moves = moves.select(*keys, "trade_date", "kind", *order, F.col("_s.mult").alias("mult"), F.col("_s.delta").alias("delta"))
    lots = snapshots.groupBy(*keys, "lot_seq").agg(F.min("as_of_date").alias("start"), F.min_by("quantity", "as_of_date").cast("double").alias("q"))
    firsts = lots.groupBy(*keys).agg(F.min("start").alias("first"), F.max("start").alias("latest"), F.sum("q").alias("first_held"))

    # transfers without a record of their own stand in the ledger on their day, before its other trades
    into, out = links.withColumn("account_id", F.col("to_account")), links.withColumn("account_id", F.col("from_account"))
    blank = [F.lit(None).cast(moves.schema[c].dataType).alias(c) for c in order]
    put = lambda d, sign, kind: d.select(*keys, F.col("date").alias("trade_date"), F.lit(kind).alias("kind"), *blank, F.lit(1.0).alias("mult"), (sign * F.col("quantity")).cast("double").alias("delta"))
    earlier = moves.join(firsts.select(*keys, "first"), keys).where("trade_date < first").select(*keys).distinct()
    own = into.join(firsts.select(*keys, "first"), keys).join(earlier, keys, "left_semi")
    plain = into.join(firsts, keys, "left_anti")
    here = plain.select(*keys).unionByName(moves.join(firsts, keys, "left_anti").select(*keys)).distinct()
    gone = out.join(here, keys, "left_semi")
    added = put(_has_record(own.where("date < first"), moves, "account_id", "transfer_in"), 1, "transfer_in").unionByName(put(_has_record(plain, moves, "account_id", "transfer_in"), 1, "transfer_in")).unionByName(put(_has_record(gone, moves, "account_id", "transfer_out"), -1, "transfer_out"))
    moves = written(moves.unionByName(added), "moves")
    days = written(day_maps(moves, keys, order), "days")

    # the anchor: the first statement day without a trade
    free = snapshots.select(*keys, F.col("as_of_date").alias("day")).distinct().join(days.select(*keys, "day"), [*keys, "day"], "left_anti").groupBy(*keys).agg(F.min("day").alias("free"))
    a = firsts.join(free, keys, "left").withColumn("anchor", F.coalesce("free", "first"))
    upto = snapshots.join(a.select(*keys, "anchor"), keys).where("as_of_date <= anchor").groupBy(*keys, "lot_seq").agg(F.max_by("quantity", "as_of_date").cast("double").alias("q"))
    a = a.join(upto.groupBy(*keys).agg(F.sum("q").alias("held")), keys)
    arrived = into.join(firsts, keys).where("date <= first").groupBy(*keys, "date").agg(F.sum("quantity").alias("q")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("date", "q"))).alias("arrived"))
    any_into = into.select(*keys).distinct().withColumn("incoming", F.lit(True))
    per = days.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("day", "alpha", "beta")), asc=False).alias("days"), F.min("day").alias("first_trade"))
    all_keys = a.select(*keys).unionByName(per.select(*keys)).distinct()
    d = all_keys.join(a, keys, "left").join(per, keys, "left").join(arrived, keys, "left").join(any_into, keys, "left").join(earlier.withColumn("own", F.lit(True)), keys, "left")

    stated = F.col("first").isNotNull()
    usable = F.when(stated, F.filter("days", lambda x: x["day"] <= F.col("anchor"))).otherwise(F.col("days"))
    d = d.withColumn("u", undone(usable, F.when(stated, F.col("held")).otherwise(0.0), F.col("first")))
    total = F.aggregate("arrived", F.lit(0.0), lambda n, x: n + x["q"])
    d = d.withColumn("linked_opening", F.col("first_held") - total)
    start = F.struct(_settled(F.col("linked_opening")).alias("q"), F.array().cast(CHANGES).alias("changes"))
    step = lambda n, x: F.struct((n["q"] + x["q"]).alias("q"), F.when(x["date"] < F.col("first"), F.concat(n["changes"], F.array(_change(x["date"], n["q"] + x["q"])))).otherwise(n["changes"]).alias("changes"))
    d = d.withColumn("l", F.aggregate("arrived", start, step))
    by_link = stated & F.col("incoming") & F.col("own").isNull()
    nothing_before = (F.col("anchor") == F.col("first")) & ~F.coalesce(F.col("first_trade") < F.col("first"), F.lit(False))
    status = (
        F.when(~stated & ~F.col("u.bad"), "closed").when(~stated, "no_snapshot").when(F.col("days").isNull() & F.col("incoming").isNull(), "no_trades").when(F.col("first") != F.col("latest"), "lots_differ")
        .when(by_link & F.col("arrived").isNull(), "no_earlier_trades").when(by_link & (F.col("linked_opening") < -NOTHING), "inconsistent").when(by_link, "linked")
        .when(nothing_before, "no_earlier_trades").when(F.col("u.bad"), "inconsistent").otherwise("traced")
    )
    d = d.withColumn("status", status)
    walked, linked = F.col("status").isin("traced", "closed"), F.col("status") == "linked"
    return d.select(*keys, "status", F.col("first").alias("before"), F.when(walked, F.col("u.q")).when(linked, _settled(F.col("linked_opening"))).alias("opening"), F.when(walked, F.col("u.changes")).when(linked, F.col("l.changes")).alias("changes"))


def path_days(paths: DataFrame, start: str, end: str, also: tuple[str, ...] = ()) -> DataFrame:
    """account_id, security_id, day, quantity, estimated: paths on every day of a range before the first statement; also: other columns of the paths."""
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    p = paths.where("changes is not null").withColumn("stop", F.least(hi, F.coalesce(F.date_sub("before", 1), hi)))
    opening = F.struct(F.lit(None).cast("date").alias("day"), F.col("opening").alias("quantity"))
    p = p.select(*POSITION, *also, "stop", F.posexplode(F.concat(F.array(opening), "changes")).alias("i", "c"), F.col("changes").alias("all"))
    p = p.withColumn("from", F.greatest(lo, F.coalesce("c.day", lo))).withColumn("to", F.least("stop", F.coalesce(F.date_sub(F.get("all", F.col("i"))["day"], 1), F.col("stop"))))
    p = p.where(F.col("from") <= F.col("to")).select(*POSITION, *also, F.explode(F.sequence("from", "to")).alias("day"), F.col("c.quantity").alias("quantity"), (F.col("c.day").isNull() & (F.col("c.quantity") > NOTHING)).alias("estimated"))
    return p
