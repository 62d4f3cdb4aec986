"""Replay of a ledger against a statement: quantity, cost pool, realised result, for transactions of every type.

A transaction maps the quantity q to mult * q + delta; purchases add to the cost pool, sales scale it, a return of
capital subtracts and stops at zero. The rows of a position meet once, in runs of at most RUN rows, and are folded in
order, so that every sum is rounded as it is one row after the other. Three folds: the opening quantity that meets
the statement, the opening unit cost that meets its cost, and the replay itself. Positions of one run go through all
three where they are; those of more go run after run, a join for each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import forget, written
from .steps import ACQUIRES, acquisition_cost, proceeds, quantity_step

#: Rows of a piece (see paths), and rows of a position that are folded at once.
PIECE, RUN = 4_096, 65_536
#: Fewer rows aren't worth a join of their own.
LEAST = 1_000
#: Quantities up to this are nothing left; what a sale leaves of this share is rounding of doubles.
NOTHING, NOISE = 1e-7, 1e-10
POSITION = ["account_id", "security_id"]


def _state(**fields: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _zero(x: Column, scale: Column) -> Column:
    return F.when(F.abs(x) <= NOISE * F.abs(scale), 0.0).otherwise(x)


def step_fields(divisor: str = "divisor") -> list[Column]:
    """What the folds need to know of a transaction."""
    role = F.when(F.col("kind").isin(*ACQUIRES), "add").when(F.col("kind") == "sell", "sell").when(F.col("kind") == "transfer_out", "out").when(F.col("kind") == "split", "split").when(F.col("kind") == "return_of_capital", "roc").otherwise("none")
    absolute = lambda c: F.coalesce(F.abs(c), F.lit(0)).cast("double")
    s = quantity_step()
    return [
        role.alias("role"), absolute("quantity").alias("qty"), F.coalesce(s["mult"], F.lit(1.0)).alias("mult"), F.coalesce(s["delta"], F.lit(0.0)).alias("delta"),
        acquisition_cost(divisor).cast("double").alias("cost"), proceeds(divisor).cast("double").alias("proceeds"), absolute("fee").alias("fee"), absolute("net_amount").alias("returned"),
    ]


def _quantity_step(s: Column, t: Column) -> Column:
    return _state(alpha=s["alpha"] * t["mult"], beta=s["beta"] * t["mult"] + t["delta"])


def _pool_step(s: Column, t: Column) -> Column:
    """One transaction on q and the pool a + b * opening unit cost, without the floor at zero; bad: more was sold than held."""
    leaves = t["role"].isin("sell", "out")
    sale = leaves & (s["q"] > 0)
    left = _zero(s["q"] - t["qty"], s["q"] + t["qty"])
    keep = F.when(sale, left / s["q"]).otherwise(1.0)
    a = F.when(t["role"] == "add", s["a"] + t["cost"]).when(t["role"] == "roc", s["a"] - t["returned"]).otherwise(s["a"] * keep)
    return _state(
        q=F.when(leaves, left).otherwise(s["q"] * t["mult"] + t["delta"]), a=a, b=s["b"] * keep,
        bad=s["bad"] | (leaves & ((s["q"] <= 0) | (left < 0))), costless=s["costless"] + ((t["role"] == "add") & (t["cost"] == 0)).cast("int"),
    )


def _replay_step(s: Column, t: Column) -> Column:
    """One transaction on (q, pool, rest: the opening lot's, realized, sales, cost_sold, stops)."""
    sale = t["role"].isin("sell", "out") & (s["q"] > 0)
    left = _zero(s["q"] - t["qty"], s["q"] + t["qty"])
    keep = F.when(sale, left / s["q"]).otherwise(1.0)
    gone = s["pool"] - s["pool"] * keep
    sold = sale & (t["role"] == "sell")
    lower = s["pool"] - t["returned"]
    roc = t["role"] == "roc"
    grew = F.when(t["role"] == "split", F.when(t["mult"] != 1, t["mult"]).when(s["q"] != 0, (s["q"] + t["delta"]) / s["q"]).otherwise(1.0)).otherwise(1.0)
    moved = F.when(t["role"] == "split", t["mult"] * s["q"] + F.when(s["q"] != 0, t["delta"]).otherwise(0.0)).when(t["role"] == "add", s["q"] + t["delta"]).otherwise(s["q"])
    return _state(
        q=F.when(sale, left).otherwise(moved), pool=F.when(sale, s["pool"] * keep).when(t["role"] == "add", s["pool"] + t["cost"]).when(roc, F.greatest(lower, F.lit(0.0))).otherwise(s["pool"]),
        rest=s["rest"] * keep * grew, realized=s["realized"] + F.when(sold, t["proceeds"] - t["fee"] - gone).otherwise(0.0), sales=s["sales"] + sold.cast("int"),
        cost_sold=s["cost_sold"] + F.when(sold, gone).otherwise(0.0), stops=s["stops"] + (roc & (lower < 0)).cast("int"),
    )


def _fold(steps: str, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    # the state is named twice and more in a step: an array of one binds it, so that it is built once
    return F.aggregate(steps, start, lambda s, t: F.transform(F.array(s), lambda x: step(x, t))[0])


def _runs(d: DataFrame, keys: list[str], order: list[str], facts: list[Column]) -> DataFrame:
    """keys, run, facts, steps: at most RUN rows of a position, in order; rows that move nothing count in the facts only."""
    w = Window.partitionBy(*keys).orderBy("trade_date", *[c for c in order if c != "trade_date"])
    d = d.withColumn("_n", F.row_number().over(w)).withColumn("run", F.floor((F.col("_n") - 1) / max(RUN, LEAST)).cast("int"))
    moving = ~F.col("kind").isin("dividend", "cash_in", "cash_out", "other")
    step = F.when(moving, F.struct("_n", *step_fields()))
    return d.groupBy(*keys, "run").agg(*facts, F.sort_array(F.collect_list(step)).alias("steps"))


def _run_by_run(start: DataFrame, runs: DataFrame, keys: list[str], step: Callable[[Column, Column], Column]) -> DataFrame:
    """keys, x: the state after all runs. start: keys, x."""
    state = written(start, "state")
    for run in range(int(runs.agg(F.max("run")).first()[0]) + 1):
        now = state.join(runs.where(F.col("run") == run).select(*keys, "steps"), keys, "left")
        before, state = state, written(now.select(*keys, F.when(F.col("steps").isNull(), F.col("x")).otherwise(_fold("steps", F.col("x"), step)).alias("x")), "state")
        forget(before)
    return state


def _solved(d: DataFrame, after: Callable[[DataFrame, Column, Column, Callable], DataFrame]) -> DataFrame:
    """Positions (keys and facts) with q0, coverage, c0, bad, costless and the end of the replay; null where it doesn't get so far.

    after(d, where, start, step): d with x, the state after all of a position's steps where the condition holds.
    """
    zero, none, no = F.lit(0.0), F.lit(0), F.lit(False)
    d = after(d, ~F.coalesce("foreign", no), _state(alpha=F.lit(1.0), beta=zero), _quantity_step)
    q0 = (F.col("held") - F.col("x.beta")) / F.col("x.alpha")
    d = d.withColumn("q0", F.when(F.abs(q0) <= NOTHING, 0.0).otherwise(q0)).drop("x")
    d = after(d, F.col("q0") >= 0, _state(q=F.col("q0"), a=zero, b=F.col("q0") / F.col("divisor"), bad=no, costless=none), _pool_step).withColumnRenamed("x", "p")
    c0 = F.when(F.col("p.b") != 0, (F.col("held") * F.col("held_cost") / F.col("divisor") - F.col("p.a")) / F.col("p.b"))
    d = d.withColumn("c0", c0)
    coverage = F.when(F.col("p").isNull(), None).when(F.col("p.b") == 0, "full").when(F.col("held_cost").isNull(), "partial_uncosted").when(F.col("c0") < 0, "unreconciled").otherwise("partial")
    d = d.withColumn("coverage", coverage)
    pool = F.coalesce(F.col("q0") * F.col("c0") / F.col("divisor"), zero)
    start = _state(q=F.col("q0"), pool=pool, rest=F.col("q0"), realized=zero, sales=none, cost_sold=zero, stops=none)
    d = after(d, F.col("coverage") != "unreconciled", start, _replay_step)
    return d.withColumns({"irregular": F.col("p.bad"), "costless": F.col("p.costless")}).select("*", "x.pool", "x.rest", "x.realized", "x.sales", "x.cost_sold", F.col("x.stops").cast("long").alias("stops"))


def reconciled_positions(tx: DataFrame, anchors: DataFrame, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """One row a position with a transaction: how its ledger and its statement fit.

    tx: keys, trade_date, kind, quantity, unit_price, gross_amount, net_amount, fee, tax, split_ratio, divisor, currency
    and order. anchors: keys, as_of_date, quantity, avg_cost, currency, lots, acquired_on; a position without one is
    closed: it is held against nothing, as of the latest statement or its last trade. Trades after as_of_date are left
    out. A trade in another currency makes the position unreconciled.

    coverage: full (nothing of the opening lot is left), partial (its unit cost follows from the statement),
    partial_uncosted, unreconciled. opening_quantity, opening_cost, residual_quantity, covered_quantity, avg_cost,
    realized (null without a sale), cost_sold, income, withheld, tx_count, first and last trade, acquired_on, applies
    (full, one lot, cost known), irregular, closed, roc_stops, costless_transfers. Unknown values are null.
    """
    keys = keys or POSITION
    a = anchors.select(*keys, "as_of_date", F.col("quantity").cast("double").alias("held"), F.col("avg_cost").cast("double").alias("held_cost"), F.col("currency").alias("held_currency"), "lots", F.col("acquired_on").alias("held_since"))
    a = written(a, "anchors")
    latest = a.agg(F.max("as_of_date").alias("_latest"))
    d = tx.join(a, keys, "left").join(F.broadcast(latest))  # one row
    d = d.withColumn("closed", F.col("as_of_date").isNull())
    d = d.where(F.col("closed") & F.col("_latest").isNotNull() | (F.col("trade_date") <= F.col("as_of_date")))
    buys = F.when(F.col("kind").isin(*ACQUIRES), F.col("trade_date"))
    absolute = lambda c: F.coalesce(F.abs(c), F.lit(0)).cast("double")
    taken = {"closed": F.first, "held": F.first, "held_cost": F.first, "lots": F.first, "held_since": F.first, "divisor": F.first, "foreign": F.max, "tx_count": F.sum, "first_trade": F.min, "last_trade": F.max, "income": F.sum, "withheld": F.sum, "first_buy": F.min}
    facts = [
        F.first("closed").alias("closed"), F.coalesce(F.first("held"), F.lit(0.0)).alias("held"), F.first("held_cost").alias("held_cost"), F.first("lots").alias("lots"), F.first("held_since").alias("held_since"),
        F.first("divisor").cast("double").alias("divisor"), F.max(~F.col("closed") & (F.col("currency") != F.col("held_currency"))).alias("foreign"), F.count("*").alias("tx_count"), F.min("trade_date").alias("first_trade"),
        F.max("trade_date").alias("last_trade"), F.sum(F.when(F.col("kind") == "dividend", absolute("net_amount")).otherwise(0.0)).alias("income"), F.sum(absolute("tax")).alias("withheld"), F.min(buys).alias("first_buy"),
    ]
    runs = written(_runs(d, keys, order, facts), "runs")
    inline = lambda d, where, start, step: d.withColumn("x", F.when(where, _fold("steps", start, step)))
    long = runs.where("run > 0").select(*keys).distinct()
    if long.isEmpty():
        out = _solved(runs, inline)
    else:
        rest = written(runs.join(long, keys, "left_semi"), "runs")
        joined = lambda d, where, start, step: d.join(_run_by_run(d.where(where).select(*keys, start.alias("x")), rest, keys, step), keys, "left")
        many = _solved(rest.groupBy(*keys).agg(*[f(c).alias(c) for c, f in taken.items()]), joined)
        out = _solved(runs.join(long, keys, "left_anti"), inline).select(many.columns).unionByName(many)
    known, full, through = ~F.col("foreign"), F.col("coverage") == "full", F.col("rest").isNotNull()
    residual = F.when(through, F.greatest(F.col("rest"), F.lit(0.0)))
    avg = F.when(full & (F.col("held") > 0), F.col("pool") * F.col("divisor") / F.col("held")).when(F.col("coverage") == "partial", F.col("held_cost"))
    return out.select(
        *keys, F.coalesce("coverage", F.lit("unreconciled")).alias("coverage"), "closed", F.col("q0").alias("opening_quantity"), F.when(F.col("coverage") == "partial", F.col("c0")).alias("opening_cost"),
        residual.alias("residual_quantity"), (F.col("held") - residual).alias("covered_quantity"), avg.alias("avg_cost"), F.when(F.col("sales") > 0, F.col("realized")).alias("realized"), F.when(F.col("sales") > 0, F.col("cost_sold")).alias("cost_sold"),
        F.when(known, F.col("income")).alias("income"), F.when(known, F.col("withheld")).alias("withheld"), F.when(known, F.col("tx_count")).alias("tx_count"), F.when(known, F.col("first_trade")).alias("first_trade"), F.when(known, F.col("last_trade")).alias("last_trade"),
        F.when(through, F.when(full & F.col("first_buy").isNotNull(), F.col("first_buy")).otherwise(F.coalesce("held_since", "first_buy"))).alias("acquired_on"),
        (full & avg.isNotNull() & (F.coalesce("lots", F.lit(1)) == 1)).alias("applies"), F.coalesce("irregular", F.lit(False)).alias("irregular"), F.col("stops").alias("roc_stops"), F.col("costless").cast("long").alias("costless_transfers"),
    )
