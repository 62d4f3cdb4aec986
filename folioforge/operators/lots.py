"""Which known lot a row of a statement is, what changed about it, and which numbers and ids new rows get.

Equal rows and lots meet by joins; only what is left of an account's security, after those, is paired in one small step.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import name_key
from ..sources.scratch import written

GROUP = ["account_id", "security_id"]
#: Sections whose lots are told apart by their label.
LABELLED = ("deposit", "crypto", "point")
#: Rows that are numbered in one task.
BUCKET = 100_000


def _numbered(rows: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def _met(rows: DataFrame, lots: DataFrame, on: list[str], row_order: list[Column | str], lot_order: list[Column | str]) -> DataFrame:
    """GROUP, row_id, lot_seq: the n-th row of equal `on` (nulls are equal) with the n-th lot."""
    r = _numbered(rows, [*GROUP, *on], row_order).select(*GROUP, "row_id", *on, "_k")
    t = _numbered(lots, [*GROUP, *on], lot_order).select(*[F.col(c).alias(f"l_{c}") for c in [*GROUP, *on, "_k"]], "lot_seq")
    same = F.lit(True)
    for c in [*GROUP, *on, "_k"]:
        same &= F.col(c).eqNullSafe(F.col(f"l_{c}"))
    return r.join(t, same).select(*GROUP, "row_id", "lot_seq")


def nearest(rows: list[tuple], lots: list[tuple]) -> Iterator[tuple[int, int]]:
    """Pairs of (id, cost, quantity), each once: always the pair that is nearest by cost, then quantity, row, lot. An unknown cost is infinitely far from a known one.

    A row's nearest free lot is found among lots sorted by cost and looked up again when it is taken, so no list of pairs is made.
    """
    by_cost: dict[float | None, list[tuple]] = {}
    for lot in lots:
        by_cost.setdefault(lot[1], []).append(lot)
    costs = sorted(c for c in by_cost if c is not None)
    far = float("inf")

    def gap(a: float | None, b: float | None) -> float:
        return 0.0 if a is None and b is None else far if a is None or b is None else abs(a - b)

    def closest(row: tuple) -> tuple | None:
        cost = row[1]
        if cost is None:
            near = [None] if None in by_cost else list(by_cost)
        elif costs:
            at = bisect.bisect_left(costs, cost)
            sides = costs[max(0, at - 1) : at + 1]
            least = min(abs(c - cost) for c in sides)
            near = [c for c in sides if abs(c - cost) == least]
        else:
            near = list(by_cost)
        return min(((gap(cost, c), gap(row[2], t[2]), row[0], t[0], c) for c in near for t in by_cost[c]), default=None)

    heap = [x for x in map(closest, rows) if x]
    heapq.heapify(heap)
    by_id, taken = {r[0]: r for r in rows}, set()
    while heap:
        _, _, row, lot, cost = heapq.heappop(heap)
        if lot in taken:
            if (again := closest(by_id[row])) is not None:
                heapq.heappush(heap, again)
            continue
        taken.add(lot)
        yield row, lot
        by_cost[cost] = [t for t in by_cost[cost] if t[0] != lot]
        if not by_cost[cost]:
            del by_cost[cost]
            if cost is not None:
                costs.pop(bisect.bisect_left(costs, cost))


def assigned(rows: DataFrame, lots: DataFrame) -> DataFrame:
    """account_id, security_id, row_id, lot_seq: the known lot that each row of a statement is; rows without one are left out.

    rows: account_id, security_id, row_id, section, label, quantity, cost; lots: account_id, security_id, lot_seq, label, quantity, cost. Rows of
    labelled sections take the lot of their label, and then, as expiries roll on, lots of their type (before the '|') in the order of
    expiry (none last). Others take lots of equal cost and quantity, and then the nearest by cost, quantity, row and lot.
    A lot is taken once; an account's security goes by the section of its first row. What is left of one must fit a task.
    """
    labelled = F.coalesce(F.col("_section").isin(*LABELLED), F.lit(False))
    rows = rows.join(rows.groupBy(*GROUP).agg(F.min_by("section", "row_id").alias("_section")), GROUP)
    rows = rows.withColumns({"label": F.coalesce("label", F.lit("")), "quantity": F.col("quantity").cast("double"), "cost": F.col("cost").cast("double")})
    lots = lots.withColumns({"label": F.coalesce("label", F.lit("")), "quantity": F.col("quantity").cast("double"), "cost": F.col("cost").cast("double")})
    named, plain = rows.where(labelled), rows.where(~labelled)

    def rest(d: DataFrame, met: DataFrame, key: str) -> DataFrame:
        return d.join(met.select(*GROUP, key), [*GROUP, key], "left_anti")

    by_label = written(_met(named, lots, ["label"], ["row_id"], ["lot_seq"]), "lots-by-label")
    parts = lambda d: d.withColumns({"type": F.substring_index("label", "|", 1), "expiry": F.when(F.col("label").contains("|"), F.expr("substring(label, instr(label, '|') + 1)")).otherwise("")})
    soon: list[Column | str] = [F.col("expiry") == "", "expiry"]
    by_type = _met(parts(rest(named, by_label, "row_id")), parts(rest(lots, by_label, "lot_seq").join(named.select(*GROUP).distinct(), GROUP, "left_semi")), ["type"], [*soon, "row_id"], [*soon, "lot_seq"])
    equal = written(_met(plain, lots, ["cost", "quantity"], ["row_id"], ["lot_seq"]), "lots-equal")

    def pair(rows: pd.DataFrame, lots: pd.DataFrame) -> pd.DataFrame:
        plain = lambda d, key: [(int(i), None if pd.isna(c) else c, None if pd.isna(q) else q) for i, c, q in zip(d[key], d["cost"], d["quantity"], strict=True)]
        found = list(nearest(plain(rows, "row_id"), plain(lots, "lot_seq"))) if len(rows) and len(lots) else []
        out = pd.DataFrame(found, columns=["row_id", "lot_seq"])
        for i, c in enumerate(GROUP):
            out.insert(i, c, rows[c].iloc[0] if len(found) else None)
        return out

    left, free = written(rest(plain, equal, "row_id").select(*GROUP, "row_id", "cost", "quantity"), "rows-left"), written(rest(lots, equal, "lot_seq").select(*GROUP, "lot_seq", "cost", "quantity"), "lots-left")
    near = left.groupBy(*GROUP).cogroup(free.groupBy(*GROUP)).applyInPandas(pair, "account_id long, security_id long, row_id long, lot_seq long")
    return by_label.unionByName(by_type).unionByName(equal).unionByName(near)


def diffed(rows: DataFrame, lots: DataFrame) -> DataFrame:
    """account_id, security_id, lot_seq, row_id, status, old and new quantity and cost of every row and every known lot.

    new rows get the numbers after the largest known one, in their order; a known lot without a row is missing, unless it holds nothing.
    """
    met = written(assigned(rows, lots), "assigned")
    known = lots.select(*GROUP, "lot_seq", F.col("quantity").cast("double").alias("old_quantity"), F.col("cost").cast("double").alias("old_cost"))
    top = lots.groupBy(*GROUP).agg(F.max("lot_seq").alias("_top"))
    r = rows.select(*GROUP, "row_id", F.col("quantity").cast("double").alias("new_quantity"), F.col("cost").cast("double").alias("new_cost")).join(met, [*GROUP, "row_id"], "left")
    fresh = _numbered(r.where("lot_seq is null"), GROUP, ["row_id"]).join(top, GROUP, "left").withColumn("lot_seq", (F.coalesce("_top", F.lit(-1)) + F.col("_k")).cast("long")).drop("_top", "_k")
    d = r.where("lot_seq is not null").join(known, [*GROUP, "lot_seq"])
    status = F.when(~F.col("old_quantity").eqNullSafe(F.col("new_quantity")), "qty_changed").when(~F.col("old_cost").eqNullSafe(F.col("new_cost")), "cost_changed").otherwise("unchanged")
    columns = [*GROUP, "lot_seq", "row_id", "status", "old_quantity", "new_quantity", "old_cost", "new_cost"]
    none = F.lit(None).cast("double")
    gone = known.join(met, [*GROUP, "lot_seq"], "left_anti").where("old_quantity <> 0").withColumns({"row_id": F.lit(None).cast("long"), "status": F.lit("missing"), "new_quantity": none, "new_cost": none})
    fresh = fresh.withColumns({"status": F.lit("new"), "old_quantity": none, "old_cost": none})
    return d.withColumn("status", status).select(*columns).unionByName(fresh.select(*columns)).unionByName(gone.select(*columns))


def new_ids(keys: DataFrame, column: str, after: int, buckets: int | None = None) -> DataFrame:
    """keys (distinct, not null) with id: after + 1, after + 2, ... by bucket and key, the same on every run with the same number of rows.

    Keys are dealt into buckets by hash, numbered in each, and a bucket starts where those before it end, so no task sees all keys.
    """
    n = buckets or max(1, -(-keys.count() // BUCKET))
    d = keys.withColumn("_b", F.pmod(F.xxhash64(column), F.lit(n)))
    d = d.withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy(column)))
    sizes = d.groupBy("_b").agg(F.count("*").alias("_n"))  # one row a bucket
    starts = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_s"))
    return d.join(F.broadcast(starts), "_b").withColumn("id", (F.lit(after) + F.col("_s") + F.col("_i")).cast("long")).drop("_b", "_i", "_s")


def ensured(targets: DataFrame, accounts: DataFrame, securities: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(targets with account_id, new_account, known_security, new_security; new accounts; new securities) of what may be committed.

    targets: batch, ref, account, name, name_key, code, security_id (a choice, or null); accounts: account_id, name; securities: security_id, code,
    name_key; aliases: alias, security_id. A batch with a row that names no account is left out as a whole. A security is the choice, if it
    exists, else that of the code, of the alias, of the name (several: the smallest id); names cut short are resolved before (see
    prefix_unique). What isn't there is new once, by code or else by name, and gets the ids after the largest known one.
    """
    blank = F.trim(F.coalesce("account", F.lit(""))) == ""
    t = targets.join(targets.where(blank).select("batch").distinct(), "batch", "left_anti")
    top = lambda d, c: d.agg(F.coalesce(F.max(c), F.lit(0))).first()[0]
    have = accounts.groupBy(F.col("name").alias("account")).agg(F.min("account_id").alias("account_id"))
    opened = written(new_ids(written(t.select("account").distinct().join(have, "account", "left_anti"), "open"), "account", top(accounts, "account_id")).withColumnRenamed("id", "account_id"), "accounts")
    t = t.join(have.withColumn("new_account", F.lit(False)).unionByName(opened.withColumn("new_account", F.lit(True))), "account")
    one = lambda d, key, name: d.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(name)).agg(F.min("security_id").alias(f"_by_{name}"))
    ids = securities.select(F.col("security_id").alias("_by_id"))
    t = t.join(ids, F.col("security_id") == F.col("_by_id"), "left").join(one(securities, "code", "code"), "code", "left")
    t = t.join(one(aliases, "alias", "_alias"), F.col("name_key") == F.col("_alias"), "left").join(one(securities, "name_key", "_name"), F.col("name_key") == F.col("_name"), "left")
    known = F.coalesce("_by_id", "_by_code", "_by__alias", "_by__name")
    t = written(t.withColumns({"_known": known, "_identity": F.coalesce(F.when(F.col("code") != "", F.col("code")), F.col("name_key"))}), "resolved")
    # rows of one identity become one security: what is known of any of them, the first by ref
    of = t.groupBy("_identity").agg(F.min_by("_known", F.when(F.col("_known").isNotNull(), F.struct("batch", "ref"))).alias("known_security"), F.min_by(F.struct("code", "name", "name_key"), F.struct("batch", "ref")).alias("_first"))
    made = written(new_ids(written(of.where("known_security is null").select(F.col("_identity").alias("identity"), "_first"), "unknown"), "identity", top(securities, "security_id")), "securities")
    out = t.drop("security_id").join(of.select("_identity", "known_security"), "_identity").join(made.select(F.col("identity").alias("_identity"), F.col("id").alias("new_security")), "_identity", "left")
    return out.select("batch", "ref", "account", "account_id", "new_account", "known_security", "new_security"), opened.select("account_id", F.col("account").alias("name")), made.select(F.col("id").alias("security_id"), "_first.code", "_first.name", "_first.name_key")


def overridden(rows: DataFrame, choices: DataFrame, members: DataFrame, confidence: float = 0.7) -> DataFrame:
    """rows with security_id, matched_by and included as a user chose: choices (name, security_id; null: leave the name out).

    rows: name, security_id, matched_by, included, confidence, duplicate. A choice for one name of a group (members: name, group) holds for its other
    names that have none of their own, first the group's own name, then the others by name; names are compared as they are, then by
    their key. Rows that were resolved otherwise than by price or quantity stay.
    """
    c = choices.groupBy("name").agg(F.max(F.struct(F.lit(True).alias("yes"), F.col("security_id").cast("long").alias("to"))).alias("_own"))
    m = members.join(c, "name", "left")
    hit = m.where("_own is not null").groupBy("group").agg(F.min_by("_own", F.struct(F.col("name") != F.col("group"), "name")).alias("_hit"))
    spread = m.join(hit, "group").select("name", F.coalesce("_own", "_hit").alias("_own"))
    every = written(spread.unionByName(c.join(members.select("name"), "name", "left_anti")), "choices")
    key = name_key(F.col("name"))
    keyed = every.withColumn("_key", key).where("_key <> ''").groupBy("_key").agg(F.max_by("_own", "name").alias("_by_key"))
    d = rows.withColumn("_key", key).join(every, "name", "left").join(keyed, "_key", "left").withColumn("_x", F.coalesce("_own", "_by_key"))
    free = F.col("security_id").isNull() | F.col("matched_by").isin("price", "quantity")
    chosen = free & F.col("_x").isNotNull()
    to = F.col("_x.to")
    d = d.withColumn("_chosen", F.coalesce(chosen, F.lit(False)))
    values = {
        "security_id": F.when(F.col("_chosen"), to).otherwise(F.col("security_id")), "matched_by": F.when(~F.col("_chosen"), F.col("matched_by")).when(to.isNotNull(), "manual").otherwise("unmatched"),
        "included": F.when(~F.col("_chosen"), F.col("included")).otherwise(to.isNotNull() & (F.col("confidence") >= confidence) & ~F.coalesce("duplicate", F.lit(False))),
    }
    return d.withColumns(values).select(*rows.columns)
