"""Entity resolution and matching between ledgers, snapshots and names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import compared, likeness, refined
from ..sources.scratch import forget, written


def resolved(names: DataFrame, codes: DataFrame, aliases: DataFrame, keys: DataFrame) -> DataFrame:
    """names (ref, code, name_key) with security_id by code, then alias, then a unique name key; resolved_by says which."""
    unique = keys.groupBy("name_key").agg(F.min("security_id").alias("by_key"), F.count("*").alias("n")).where("n = 1").drop("n")
    d = names.join(codes.select("code", F.col("security_id").alias("by_code")), "code", "left")
    d = d.join(aliases.select(F.col("alias").alias("name_key"), F.col("security_id").alias("by_alias")), "name_key", "left").join(unique, "name_key", "left")
    how = F.when(F.col("by_code").isNotNull(), "code").when(F.col("by_alias").isNotNull(), "alias").when(F.col("by_key").isNotNull(), "name").otherwise("none")
    return d.select("ref", F.coalesce("by_code", "by_alias", "by_key").alias("security_id"), how.alias("resolved_by"))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new / missing / qty_changed / cost_changed / unchanged of every lot of two snapshots."""
    o = old.select(*keys, F.col("quantity").alias("old_quantity"), F.col("cost").alias("old_cost"), F.lit(True).alias("_o"))
    n = new.select(*keys, F.col("quantity").alias("new_quantity"), F.col("cost").alias("new_cost"), F.lit(True).alias("_n"))
    j = o.join(n, keys, "full_outer")
    status = (
        F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "missing").when(~F.col("old_quantity").eqNullSafe(F.col("new_quantity")), "qty_changed")
        .when(~F.col("old_cost").eqNullSafe(F.col("new_cost")), "cost_changed").otherwise("unchanged")
    )
    return j.withColumn("status", status).drop("_o", "_n")


def transfer_candidates(out: DataFrame, into: DataFrame, early: int = 7, late: int = 30, best: int = 3) -> DataFrame:
    """Arrivals that may belong to a departure: same security, another account, a window of days; with gap, the difference of quantities.

    Ranked by equal quantity, not early, distance in days, gap, account and row; parts of a transfer stay candidates.
    A stretch of days is part of the join's key: a departure meets the two stretches that its window touches.
    """
    span = early + late + 1
    stretch = lambda c, days: F.floor(F.datediff(F.date_add(c, days), F.lit("1970-01-01").cast("date")) / span)
    o = out.select(F.col("ref").alias("out_ref"), F.col("security_id"), F.col("quantity").alias("out_quantity"), F.col("account_id").alias("from_account"), F.col("trade_date").alias("out_date"))
    o = o.withColumn("stretch", F.explode(F.array_distinct(F.array(stretch(F.col("out_date"), -early), stretch(F.col("out_date"), late)))))
    i = into.select(F.col("ref").alias("in_ref"), "security_id", F.col("quantity").alias("in_quantity"), F.col("account_id").alias("to_account"), F.col("trade_date").alias("in_date"))
    i = i.withColumn("stretch", stretch(F.col("in_date"), 0))
    days, gap = F.datediff("in_date", "out_date"), F.abs(F.col("out_quantity") - F.col("in_quantity"))
    j = o.join(i, ["security_id", "stretch"]).where((F.col("from_account") != F.col("to_account")) & (days >= -early) & (days <= late))
    j = j.withColumns({"days": days.cast("long"), "gap": gap}).drop("stretch")
    w = Window.partitionBy("out_ref").orderBy(F.col("gap") != 0, F.col("days") < 0, F.abs("days"), "gap", "to_account", "in_ref")
    return j.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= best)


#: Names that are compared at once, letters that are counted at once, names of a block that travels.
NAMES, LETTERS, PACKED = 512, 64, 20_000


def _letters(names: list[str], columns: dict[str, int]) -> np.ndarray:
    out = np.zeros((len(names), len(columns)), np.int16)
    for i, name in enumerate(names):
        for c in name:
            if c in columns:
                out[i, columns[c]] += 1
    return out


def alike(left: list[str], right: list[str], least: float) -> Iterator[tuple[int, int, float]]:
    """Positions and score of all pairs that reach `least`.

    Matching blocks have no more letters than both names have in common, whatever their order, so the pairs whose
    common letters are too few for `least` can't reach it: the others are scored. That loses nothing; where one name
    holds the other, all letters of the shorter one are common.
    """
    a, b = [compared(x) for x in left], [compared(x) for x in right]
    columns = {c: i for i, c in enumerate(sorted(set("".join(a)) & set("".join(b))))}
    x, y = _letters(a, columns), _letters(b, columns)
    common = np.zeros((len(a), len(b)), np.int32)
    for lo in range(0, len(columns), LETTERS):
        common += np.minimum(x[:, None, lo : lo + LETTERS], y[None, :, lo : lo + LETTERS]).sum(axis=2)
    sizes = np.array([len(t) for t in a])[:, None] + np.array([len(t) for t in b])[None, :]
    for i, j in zip(*np.nonzero((2 * common >= (least - 1e-4) * sizes) & (common > 0)), strict=True):
        score = likeness(left[i], right[j])
        if score >= least:
            yield int(i), int(j), score


def suggested(names: DataFrame, universe: DataFrame, least: float = 0.5, best: int = 5, blocks: int | None = None) -> DataFrame:
    """name, other, score, refined, rank: the best names of the universe for each other name, at a score of `least` and more.

    names (name) is the set that is asked about, universe (other) what is searched; both are made distinct, nulls take
    no part. Names are packed into blocks; every block of names meets every block of the universe in a task, which
    returns only the best of each name. refined is the likeness of what tells the two apart.
    """
    names, universe = (written(d.select(c).where(f"{c} is not null").distinct(), "names") for d, c in ((names, "name"), (universe, "other")))
    blocks = blocks or max(names.sparkSession.sparkContext.defaultParallelism, max(names.count(), universe.count()) // PACKED + 1)

    def packed(d: DataFrame, column: str) -> DataFrame:
        d = d.select(F.col(column).alias("x"))
        return d.withColumn("g", F.pmod(F.xxhash64("x"), F.lit(blocks))).groupBy("g").agg(F.sort_array(F.collect_list("x")).alias(column))

    a = packed(names, "name").withColumnRenamed("g", "ga")
    b = packed(universe, "other").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("ga"), "other")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for left, right in zip(pdf["name"], pdf["other"], strict=True):
                left, right = list(left), list(right)
                for lo in range(0, len(left), NAMES):
                    part = left[lo : lo + NAMES]
                    kept: dict[int, list[tuple[float, str]]] = {}
                    for at in range(0, len(right), NAMES):
                        for i, j, score in alike(part, right[at : at + NAMES], least):
                            other = right[at + j]
                            if other != part[i]:
                                kept[i] = sorted([*kept.get(i, []), (-score, other)])[:best]
                    yield pd.DataFrame([(part[i], other, -score, refined(part[i], other, -score)) for i, found in kept.items() for score, other in found], columns=["name", "other", "score", "refined"])

    found = a.join(b, "ga").select("name", "other").mapInPandas(search, "name string, other string, score double, refined double")
    w = Window.partitionBy("name").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= best)


def unique_matches(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Pairs that match each other and nothing else on either side; sides are counted before the join."""
    once = lambda d: d.groupBy(*on).agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in d.columns if c not in on]).where("n = 1").drop("n")
    return once(left).join(once(right), on)


def survivors(securities: DataFrame, same: str) -> DataFrame:
    """Of securities that are the same, the one that stays: most trades, then latest trade, then smallest id."""
    best = F.max_by("security_id", F.struct("trades", "last_trade", -F.col("security_id"))).alias("survivor")
    return securities.join(securities.groupBy(same).agg(best, F.count("*").alias("members")), same)


def price_confirmed(trades: DataFrame, series: DataFrame, tolerance: float, days: int = 4) -> DataFrame:
    """Per security, trades whose price agrees with the series on that day or the next session within `days`; both meet month by month."""
    month = lambda c: F.trunc(c, "MM")
    s = series.select(F.col("security_id").alias("_s"), "date", "price", month("date").alias("_sm"))
    t = trades.withColumn("_m", F.explode(F.sequence(month("trade_date"), month(F.date_add("trade_date", days)), F.expr("interval 1 month"))))
    d = t.join(s, (F.col("security_id") == F.col("_s")) & (F.col("_m") == F.col("_sm")) & (F.col("date") >= F.col("trade_date")) & (F.col("date") <= F.date_add("trade_date", days)), "left")
    d = d.groupBy("security_id", "ref").agg(F.first("unit_price").alias("unit_price"), F.min_by("price", "date").alias("price"))
    ok = F.col("price").isNotNull() & (F.abs(F.col("unit_price") - F.col("price")) <= tolerance * F.col("price"))
    return d.groupBy("security_id").agg(F.count("*").alias("trades"), F.count("price").alias("priced"), F.sum(ok.cast("long")).alias("confirmed"))


def code_components(pairs: DataFrame) -> DataFrame:
    """Entities that share codes, directly or through others: entity, component (the smallest entity reached).

    A round takes the smallest label from entities to codes and back, each a grouped minimum, and then the label's
    own label, so long chains halve. It ends when nothing changes. A null code links nothing; null entities take no part.
    """
    p = written(pairs.where("entity is not null").select("entity", "code").distinct(), "codes")
    labels = written(p.select("entity").distinct().withColumn("component", F.col("entity")), "labels")
    while True:
        code = p.join(labels, "entity").groupBy("code").agg(F.min("component").alias("c"))
        near = p.join(code, "code").groupBy("entity").agg(F.min("c").alias("near"))
        lower = written(labels.join(near, "entity", "left").select("entity", F.col("component").alias("before"), F.least("component", "near").alias("component")), "labels")
        if not lower.where("component < before").limit(1).count():
            forget(p, lower)
            return labels
        jump = lower.select(F.col("entity").alias("component"), F.col("component").alias("next"))
        old, labels = labels, written(lower.join(jump, "component").select("entity", F.least("component", "next").alias("component")), "labels")
        forget(old, lower)
