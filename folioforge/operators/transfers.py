"""Transfers of positions between accounts: what left, where it arrived, and which departure an arrival explains.

Departures are transfers out that nothing came in against, and statements that fall to nothing without a sale. Each
account's appearance with a security is summed up in one row; only accounts with a quantity that some departure of the
security has go on. Departures are then settled in order of their day, security by security.
"""

from __future__ import annotations

import datetime as dt
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .paths import day_maps
from .replay import NOTHING, POSITION
from .steps import quantity_step

#: Days within which transfers of one account cancel; days by which an arrival may precede and follow its departure; days
#: after which an appearance is no arrival; relative difference of equal unit costs.
CANCEL, EARLY, ARRIVE, WINDOW, COST = 10, 7, 30, 400, 0.02
#: Quantities are looked up by so many decimals, and the ones beside.
DECIMALS = 6
DEPARTURE = "security_id long, account_id long, date date, quantity double, source string, cost double, closed boolean"
MANUAL = "security_id long, from_account long, to_account long, date date, quantity double"
OUTCOME = "security_id long, from_account long, date date, quantity double, source string, to_account long, outcome string, cost_match boolean, absorbed array<string>, matches long"


def totals(statements: DataFrame) -> DataFrame:
    """keys, date, total, cost: each statement day's quantity over all lots (the latest of each) and their mean cost.

    A lot counts by what it changes, so one running sum over a position's days does.
    """
    lot = Window.partitionBy(*POSITION, "lot_seq").orderBy("as_of_date")
    q, c = F.col("quantity").cast("double"), F.col("avg_cost").cast("double")
    held = q > NOTHING
    priced = held & F.coalesce(c > 0, F.lit(False))
    d = statements.select(*POSITION, "lot_seq", "as_of_date", q.alias("q"), F.when(held, q).otherwise(0.0).alias("w"), F.when(priced, q * c).otherwise(0.0).alias("qc"), (held & ~priced).cast("int").alias("unknown"))
    change = [(F.col(x) - F.coalesce(F.lag(x).over(lot), F.lit(0))).alias(x) for x in ("q", "w", "qc", "unknown")]
    day = d.select(*POSITION, "as_of_date", *change).groupBy(*POSITION, F.col("as_of_date").alias("date")).agg(*[F.sum(x).alias(x) for x in ("q", "w", "qc", "unknown")])
    run = Window.partitionBy(*POSITION).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    day = day.select(*POSITION, "date", *[F.sum(x).over(run).alias(x) for x in ("q", "w", "qc", "unknown")])
    return day.select(*POSITION, "date", F.col("q").alias("total"), F.when((F.col("unknown") == 0) & (F.col("w") > NOTHING), F.col("qc") / F.col("w")).alias("cost"))


def snapshot_departures(statements: DataFrame, tx: DataFrame) -> DataFrame:
    """DEPARTURE rows: positions whose statements fall from something to nothing with no sale or transfer out in (previous day, day].

    The interval and the trades meet month by month.
    """
    w = Window.partitionBy(*POSITION).orderBy("date")
    t = totals(statements).withColumn("was", F.lag("total").over(w)).withColumn("was_cost", F.lag("cost").over(w)).withColumn("since", F.lag("date").over(w))
    fell = t.where((F.col("was") > NOTHING) & (F.col("total") <= NOTHING)).select(*POSITION, "date", "since", F.col("was").alias("quantity"), F.col("was_cost").alias("cost"))
    month = lambda c: F.trunc(c, "MM")
    spread = fell.select(*POSITION, "date", "since", F.explode(F.sequence(month(F.date_add("since", 1)), month(F.col("date")), F.expr("interval 1 month"))).alias("month"))
    left = tx.where(F.col("kind").isin("sell", "transfer_out")).select(*POSITION, F.col("trade_date").alias("day"), month("trade_date").alias("month"))
    known = spread.join(left, [*POSITION, "month"]).where("day > since and day <= date").select(*POSITION, "date").distinct()
    return fell.join(known, [*POSITION, "date"], "left_anti").select("security_id", "account_id", "date", "quantity", F.lit("snapshot").alias("source"), "cost", F.lit(True).alias("closed"))


def _cancelled(net: list[tuple[dt.date, float]]) -> Iterator[tuple[dt.date, float]]:
    """What is left of each day's net outflow after net inflows of the days about it, nearest first, earlier days of equally near ones."""
    spare = {d: n for d, n in net if n > NOTHING}
    for d, left in sorted((d, -n) for d, n in net if n < -NOTHING):
        for day in sorted(spare, key=lambda x, d=d: (abs((x - d).days), x)):
            if abs((day - d).days) > CANCEL or left <= NOTHING:
                break
            used = min(spare[day], left)
            spare[day], left = spare[day] - used, left - used
        if left > NOTHING:
            yield d, left


def _cancel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stretches one after the other: rows come sorted by position and stretch, which batches may cut."""
    rows = (r for b in batches for r in b[[*POSITION, "stretch", "date", "net"]].itertuples(index=False, name=None))
    out = []
    for (account, security, _), part in groupby(rows, key=lambda r: r[:3]):
        out += [(account, security, *x) for x in _cancelled([r[3:] for r in part])]
        if len(out) >= 10_000:
            yield pd.DataFrame(out, columns=[*POSITION, "date", "quantity"])
            out = []
    yield pd.DataFrame(out, columns=[*POSITION, "date", "quantity"])


def _day_balances(tx: DataFrame, order: list[str]) -> DataFrame:
    """keys, day, balance: what a position holds after each day by its trades alone, from nothing."""
    s = quantity_step()
    moves = tx.withColumn("_s", s).where("_s is not null").select(*POSITION, "trade_date", *[c for c in order if c != "trade_date"], F.col("_s.mult").alias("mult"), F.col("_s.delta").alias("delta"))
    days = day_maps(moves, POSITION, [c for c in order if c != "trade_date"]).groupBy(*POSITION).agg(F.sort_array(F.collect_list(F.struct("day", "alpha", "beta"))).alias("days"))
    start = F.struct(F.lit(0.0).alias("q"), F.array().cast("array<struct<day:date,balance:double>>").alias("seen"))

    def step(a: Column, d: Column) -> Column:
        after = d["alpha"] * a["q"] + d["beta"]
        return F.struct(after.alias("q"), F.concat(a["seen"], F.array(F.struct(d["day"].alias("day"), after.alias("balance")))).alias("seen"))

    return days.select(*POSITION, F.explode(F.aggregate("days", start, step, lambda a: a["seen"])).alias("x")).select(*POSITION, "x.*")


def ledger_departures(tx: DataFrame, order: list[str]) -> DataFrame:
    """DEPARTURE rows: a day's transfers out of a position that transfers in of the days about it don't cancel.

    Days with more than CANCEL days between them don't meet, so a position is cut at such gaps; stretches without
    both directions need no matching.
    """
    way = F.when(F.col("kind") == "transfer_in", F.abs("quantity")).when(F.col("kind") == "transfer_out", -F.abs("quantity")).cast("double")
    out = F.col("kind") == "transfer_out"
    d = tx.where(F.col("kind").isin("transfer_in", "transfer_out")).withColumn("way", F.coalesce(way, F.lit(0.0)))
    price = F.when(F.col("unit_price") > 0, F.col("unit_price").cast("double"))
    days = d.groupBy(*POSITION, F.col("trade_date").alias("date")).agg(
        F.sum("way").alias("net"), F.when(F.count_if(out & price.isNull()) == 0, F.try_divide(F.sum(F.when(out, -F.col("way") * price)), F.sum(F.when(out, -F.col("way"))))).alias("cost")
    )
    w = Window.partitionBy(*POSITION).orderBy("date")
    days = days.withColumn("stretch", F.sum(F.coalesce((F.datediff("date", F.lag("date").over(w)) > CANCEL).cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = Window.partitionBy(*POSITION, "stretch")
    days = written(days.withColumn("ins", F.max("net").over(whole) > NOTHING).withColumn("outs", F.min("net").over(whole) < -NOTHING).where("outs"), "days")
    alone = days.where(~F.col("ins") & (F.col("net") < -NOTHING)).select(*POSITION, "date", (-F.col("net")).alias("quantity"))
    met = days.where("ins").select(*POSITION, "stretch", "date", "net").repartition(*POSITION, "stretch").sortWithinPartitions(*POSITION, "stretch", "date").mapInPandas(_cancel, "account_id long, security_id long, date date, quantity double")
    left = written(alone.unionByName(met).join(days.select(*POSITION, "date", "cost"), [*POSITION, "date"]), "left")
    balance = _day_balances(tx.join(left.select(*POSITION).distinct(), POSITION, "left_semi"), order).withColumnRenamed("day", "date")
    left = left.join(balance, [*POSITION, "date"], "left")
    return left.select("security_id", "account_id", "date", "quantity", F.lit("ledger").alias("source"), "cost", F.coalesce(F.abs("balance") <= NOTHING, F.lit(False)).alias("closed"))


def appearances(tx: DataFrame, statements: DataFrame, order: list[str], ref: str) -> DataFrame:
    """One row an account and security: how it appears there, whatever the departure that is asked about.

    ins: transfers in (trade, settle, quantity, price, ref), in order; stated: statement days with total and cost; first
    day of anything and what is held on it; first day of another record than a transfer in; first day with something on
    a statement; first day that a trade moves the position, its quantity and whether it buys; last days.
    """
    o = [c for c in order if c != "trade_date"]
    ins = F.struct("trade_date", *o, F.col("settle_date").alias("settle"), F.coalesce(F.abs("quantity"), F.lit(0)).cast("double").alias("q"), F.col("unit_price").cast("double").alias("price"), F.col(ref).alias("_ref"))
    is_in, moves = F.col("kind") == "transfer_in", quantity_step().isNotNull()
    t = tx.groupBy(*POSITION).agg(
        F.transform(F.sort_array(F.collect_list(F.when(is_in, ins))), lambda x: F.struct(x["trade_date"].alias("day"), x["settle"].alias("settle"), x["q"].alias("q"), x["price"].alias("price"), x["_ref"].alias("ref"))).alias("ins"),
        F.min("trade_date").alias("first_tx"), F.max("trade_date").alias("last_tx"), F.min(F.when(~is_in, F.col("trade_date"))).alias("first_other"), F.min(F.when(moves, F.col("trade_date"))).alias("first_move"),
    )
    buys = tx.where(F.col("kind") == "buy").groupBy(*POSITION).agg(F.min("trade_date").alias("first_buy"))
    s = totals(statements).groupBy(*POSITION).agg(F.sort_array(F.collect_list(F.struct("date", "total", "cost"))).alias("stated"))
    some = statements.where(F.col("quantity") > NOTHING).groupBy(*POSITION).agg(F.min("as_of_date").alias("first_held"))
    b = _day_balances(tx, order)
    d = t.join(s, POSITION, "full").join(some, POSITION, "left").join(buys, POSITION, "left")
    move = b.withColumnRenamed("balance", "move_quantity").withColumnRenamed("day", "first_move")
    d = d.join(move, [*POSITION, "first_move"], "left")
    first = F.least("first_tx", F.get("stated", F.lit(0))["date"])
    on_statement = F.when(F.get("stated", F.lit(0))["date"] == first, F.get("stated", F.lit(0))["total"])
    by_trades = F.when(F.col("first_move") == first, F.col("move_quantity")).otherwise(0.0)
    return d.withColumn("first_day", first).withColumn("first_quantity", F.coalesce(on_statement, by_trades)).withColumn("starts_with_buy", F.coalesce(F.col("first_buy") == F.col("first_move"), F.lit(False))).drop("first_buy")


def _quantities() -> Column:
    """Every quantity that an appearance can have."""
    sums = F.aggregate("ins", F.array().cast("array<double>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + x["q"])))
    return F.array_compact(F.concat(F.coalesce(sums, F.array().cast("array<double>")), F.coalesce(F.transform("stated", lambda s: s["total"]), F.array().cast("array<double>")), F.array("first_quantity", "move_quantity")))


class Arrival(NamedTuple):
    account: int
    effective: dt.date
    quantity: float
    cost: float | None
    kind: str
    early: bool
    absorbed: list[str]


def _mean(rows: list) -> float | None:
    if any(p is None or p != p or p <= 0 for _, p in rows):
        return None
    total = sum(q for q, _ in rows)
    return sum(q * p for q, p in rows) / total if total > 0 else None


def arrival(day: dt.date, a: dict) -> Arrival | None:
    """How an account appears to a departure of that day; None if it has no record from EARLY days before on."""
    lo, hi = day - dt.timedelta(EARLY), day + dt.timedelta(ARRIVE)
    near = lambda d: d is not None and lo <= d <= hi
    moved = [x for x in a["ins"] if near(x["day"]) or near(x["settle"])]
    after = lambda d: d is not None and d >= lo
    if not moved and not after(a["last_tx"]) and not (a["stated"] and after(a["stated"][-1]["date"])):
        return None
    before = lambda d: d is not None and d < lo
    if before(a["first_held"]) or before(a["first_other"]):
        return Arrival(a["account_id"], a["first_day"], a["first_quantity"], None, "other", True, [])
    rows = [x for x in a["ins"] if x["day"] < lo or near(x["day"]) or near(x["settle"])]
    if rows:
        return Arrival(a["account_id"], day, sum(x["q"] for x in rows), _mean([(x["q"], x["price"]) for x in rows]), "transfer_in", False, [x["ref"] for x in rows])
    stated = next((s for s in a["stated"] if s["date"] >= lo), None)
    if a["first_move"] is not None and (stated is None or a["first_move"] < stated["date"]):
        return Arrival(a["account_id"], a["first_move"], a["move_quantity"], None, "buy" if a["starts_with_buy"] else "other", False, [])
    return Arrival(a["account_id"], stated["date"], stated["total"], stated["cost"], "snapshot", False, []) if stated else None


def same_cost(carried: float | None, cost: float | None) -> bool | None:
    known = all(x is not None and x == x and x > 0 for x in (carried, cost))
    return abs(cost - carried) / carried <= COST if known else None


def chosen(day: dt.date, found: list[tuple[Arrival, bool | None]]) -> tuple[Arrival, bool | None] | None:
    """Of arrivals with the departure's quantity the one that explains it, if there is only one: of equal cost if any is, earliest first."""
    pool = [(a, c) for a, c in found if not a.early and c is not False and a.kind in ("snapshot", "transfer_in") and (a.effective - day).days <= WINDOW]
    pool = [x for x in pool if x[1]] or pool
    first = min((a.effective for a, _ in pool), default=None)
    earliest = [x for x in pool if x[0].effective == first]
    return earliest[0] if len(earliest) == 1 else None


def _settle(outs: pd.DataFrame, accounts: pd.DataFrame) -> Iterator[tuple]:
    none = lambda x: None if x is None or x != x else x
    known = {}
    for a in accounts.to_dict("records"):
        a = {k: (None if not isinstance(v, (list, tuple)) and not hasattr(v, "__len__") and v != v else v) for k, v in a.items()}
        known[a["account_id"]] = a | {k: [x.asDict() if hasattr(x, "asDict") else dict(x) for x in (a[k] if a[k] is not None else [])] for k in ("ins", "stated")} | {k: None if pd.isna(a[k]) else a[k] for k in ("first_day", "last_tx", "first_other", "first_move", "first_held")}
    by_quantity = defaultdict(list)
    for i, a in known.items():
        for key in {k for q in a["quantities"] for k in (round(q, DECIMALS), round(q - NOTHING, DECIMALS), round(q + NOTHING, DECIMALS))}:
            by_quantity[key].append(i)
    consumed, decided = set(), {}
    manual = outs[outs["source"] == "manual"]
    for m in manual.sort_values(["date", "account_id"]).to_dict("records"):
        decided[m["account_id"], m["date"]] = m
        to = none(m["to_account"])
        if to is not None:
            consumed.add(int(to))
            found = arrival(m["date"], known[int(to)]) if int(to) in known else None
            fits = found is not None and found.kind == "transfer_in" and abs(found.quantity - m["quantity"]) <= NOTHING
            yield (m["security_id"], m["account_id"], m["date"], m["quantity"], "manual", int(to), "manual", None, found.absorbed if fits else [], 0)
    for o in outs[outs["source"] != "manual"].sort_values(["date", "account_id", "source"]).to_dict("records"):
        key, cost = (o["account_id"], o["date"]), none(o["cost"])
        if key in decided:
            if none(decided[key]["to_account"]) is None:
                yield (o["security_id"], *key, o["quantity"], o["source"], None, "dismissed", None, [], 0)
            continue
        near = [known[i] for i in by_quantity.get(round(o["quantity"], DECIMALS), ()) if i not in consumed and i != o["account_id"]]
        found = [(a, same_cost(cost, a.cost)) for x in near if (a := arrival(o["date"], x)) is not None and abs(a.quantity - o["quantity"]) <= NOTHING]
        best = chosen(o["date"], found)
        if best:
            consumed.add(best[0].account)
            yield (o["security_id"], *key, o["quantity"], o["source"], best[0].account, "auto", best[1], best[0].absorbed, len(found))
        elif found or (o["source"] == "ledger" and o["closed"]):
            yield (o["security_id"], *key, o["quantity"], o["source"], None, "unresolved", None, [], len(found))


def resolved(tx: DataFrame, statements: DataFrame, order: list[str], manual: DataFrame | None = None, ref: str = "ref") -> DataFrame:
    """OUTCOME rows: the departures that are explained (auto, manual), set aside (dismissed) or to be asked about (unresolved).

    tx: POSITION, trade_date, settle_date, kind, quantity, unit_price, split_ratio, ref, order; statements: POSITION, lot_seq,
    as_of_date, quantity, avg_cost; manual: decisions (see MANUAL), of which one without to_account says that a
    departure is no transfer. Decisions come first; then departures by day and account, each taking the account whose
    appearance explains it, which no later one may take. An appearance explains a departure if its quantity is equal,
    its cost isn't known to differ, it begins with a statement or a transfer in from EARLY days before to WINDOW days
    after, and no other does as well; settlement days don't precede trade days; a departure that nothing explains is unresolved if some account has its quantity,
    or the ledger says that nothing was left. matches counts the accounts with its quantity.

    A task sees the departures of one security and the accounts that hold a quantity of theirs, no pairs.
    """
    spark = tx.sparkSession
    manual = manual if manual is not None else spark.createDataFrame([], MANUAL)
    outs = ledger_departures(tx, order).unionByName(snapshot_departures(statements, tx)).withColumn("to_account", F.lit(None).cast("long"))
    said = manual.select("security_id", F.col("from_account").alias("account_id"), "date", F.col("quantity").cast("double").alias("quantity"), F.lit("manual").alias("source"), F.lit(None).cast("double").alias("cost"), F.lit(False).alias("closed"), "to_account")
    outs = written(outs.unionByName(said), "departures")
    a = appearances(tx.join(outs.select("security_id").distinct(), "security_id", "left_semi"), statements.join(outs.select("security_id").distinct(), "security_id", "left_semi"), order, ref)
    a = written(a.withColumn("quantities", _quantities()), "appearances")
    asked = outs.select("security_id", F.explode(F.array(*[F.round(F.col("quantity") + x, DECIMALS) for x in (0.0, NOTHING, -NOTHING)])).alias("q")).distinct()
    fits = a.select(*POSITION, F.explode("quantities").alias("q")).withColumn("q", F.round("q", DECIMALS)).join(asked, ["security_id", "q"], "left_semi").select(*POSITION)
    named = manual.where("to_account is not null").select(F.col("to_account").alias("account_id"), "security_id")
    a = a.join(fits.unionByName(named).distinct(), POSITION, "left_semi")
    columns = [c.split(" ")[0] for c in OUTCOME.split(", ")]

    def settle(outs: pd.DataFrame, accounts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(_settle(outs, accounts)), columns=columns, dtype=object)

    return outs.groupBy("security_id").cogroup(a.groupBy("security_id")).applyInPandas(settle, OUTCOME)
