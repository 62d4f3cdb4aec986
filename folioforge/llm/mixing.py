"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Targets: every source gets its weight's share of the words, capped at `cap` times its own words; the
excess goes to the others by weight (water filling, in closed form over the sorted caps).

Copies: within a source, documents of length class k (powers of two) are wanted
mu = min(cap, c * 2^(-damping * k)) times, c solved so that the expected words meet the target. The
whole part of mu is allocated for certain. The fraction pi is the inclusion probability of one more
copy: with u uniform from a hash of the seed, the id and the text, documents are ranked by
q = (u / (1 - u)) / (pi / (1 - pi)) and taken in that order until the words left are used up (Pareto
order sampling with a fixed size in words). What the next document would overshoot is refilled, in the
same order, with documents that still fit.

No window runs over all documents: words are summed per bucket of rank, the bucket at the edge is found
from those sums, and only its documents are put in order. What is taken follows from the edges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

#: Buckets of rank for one unit of ln(q): no bucket holds more than about a thousandth of a source.
BUCKETS = 256


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """source, source_size, target from one row per document (source, size).

    Sources by code point, null last, take the weights in turn. One row per source is windowed.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int")))
    limit = F.col("source_size") * float(cap)
    # in order of cap per weight, the sources up to some point are capped: the first level that caps no other holds
    by_cap = Window.orderBy(limit / F.col("w"), F.asc_nulls_last("source"))
    everything = Window.partitionBy()
    s = s.withColumn("limit", limit)
    s = s.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / F.sum("w").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("at", F.row_number().over(by_cap))
    first = F.min(F.when(F.col("limit") >= F.col("level") * F.col("w"), F.struct("at", "level"))).over(everything)
    s = s.withColumn("first", first)
    target = F.when((F.col("at") >= F.col("first.at")), F.least(F.col("w") * F.col("first.level"), F.col("limit"))).otherwise(F.col("limit"))
    return s.select("source", "source_size", target.alias("target"))


def _class_rates(classes: DataFrame, cap: float, damping: float) -> DataFrame:
    """mu per (source, k): min(cap, c * 2^(-damping k)) with sum(words * mu) = target. A source has few classes."""
    x = F.pow(F.lit(2.0), -F.col("k") * damping)
    d = classes.withColumn("x", x)
    # classes saturate in falling x, that is in rising k
    w = Window.partitionBy("source").orderBy("k")
    d = d.withColumn("full", F.coalesce(F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * float(cap))
    d = d.withColumn("c", F.try_divide(F.col("target") - F.col("full"), F.sum(F.col("words") * F.col("x")).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))))
    d = d.withColumn("c", F.min(F.when(F.col("c") * F.col("x") <= cap * (1 + 1e-12), F.struct("k", "c"))).over(Window.partitionBy("source")))
    mu = F.when(F.col("k") < F.col("c.k"), F.lit(float(cap))).otherwise(F.least(F.col("c.c") * F.col("x"), F.lit(float(cap))))
    return d.select("source", "k", "words", "source_size", "target", F.greatest(F.coalesce(mu, F.lit(0.0)), F.lit(0.0)).alias("mu"))


def uniform(key: str, text: str, seed: int) -> Column:
    """A number strictly between 0 and 1 from id and text, the same in every run: 52 bits of an MD5 sum.

    The text is part of it, so that rows which share an id (or have none) spread over all ranks.
    """
    part = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    return (F.conv(F.substring(F.md5(part.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


NOBODY, ALL = -1.0, float("inf")


def edges(docs: DataFrame, rooms: DataFrame, rounds: int) -> DataFrame:
    """Where the order is cut. docs: source, size, pi, q; rooms: e_source, room (words left for the source).

    Returns e_source and an array of rounds' cuts (room, q): in a round, documents not taken before and of at most
    that many words are taken if their rank is at most q.
    """
    live = docs.where((F.col("pi") > 0) & (F.col("size") > 0)).select("source", "size", "q", F.floor(F.ln("q") * BUCKETS).cast("long").alias("b"))
    found = rooms.withColumn("cuts", F.lit(None).cast("array<struct<room: double, q: double>>"))
    for n in range(rounds):
        last = n == rounds - 1
        j = live.join(found, _same("source", "e_source")).where((F.col("size") <= F.col("room")) & ~F.coalesce(taken("size", "q", "cuts"), F.lit(False)))
        sums = j.groupBy("source", "b").agg(F.sum("size").alias("words"), F.max("q").alias("top"), F.first("room").alias("room"))
        over = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        sums = written(sums.withColumns({"before": F.coalesce(F.sum("words").over(over), F.lit(0)), "below": F.max("top").over(over)}), "mix-buckets")
        edge = sums.where((F.col("before") <= F.col("room")) & (F.col("before") + F.col("words") > F.col("room")))
        edge = edge.select(F.col("source").alias("x_source"), F.col("b").alias("x_b"), "before", "below")
        near = j.join(edge, _same("source", "x_source") & (F.col("b") == F.col("x_b")))
        # equal ranks go together: they share the running total
        near = near.withColumn("end", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("q")))
        # in the last round the document across the edge is taken if that brings the words nearer
        fits = F.col("end") - (F.col("size") / 2 if last else F.lit(0)) <= F.col("room")
        cut = near.groupBy(F.col("source").alias("c_source")).agg(
            F.coalesce(F.max(F.when(fits, F.col("q"))), F.first("below"), F.lit(NOBODY)).alias("q"), F.coalesce(F.max(F.when(fits, F.col("end"))), F.first("before")).alias("used")
        )
        # a source without such a bucket takes all
        every = sums.groupBy(F.col("source").alias("s_source")).agg(F.sum("words").alias("words"))
        f = found.join(cut, _same("e_source", "c_source"), "left").join(every, _same("e_source", "s_source"), "left")
        q = F.coalesce("q", F.lit(ALL))
        used = F.coalesce("used", "words", F.lit(0)).cast("double")
        new = F.struct(F.col("room").cast("double").alias("room"), q.cast("double").alias("q"))
        found = written(f.select("e_source", (F.col("room") - used).alias("room"), F.concat(F.coalesce("cuts", F.array().cast("array<struct<room: double, q: double>>")), F.array(new)).alias("cuts")), "mix-cuts")
    return found.select("e_source", "cuts")


def taken(size: str, q: str, cuts: str) -> Column:
    return F.exists(F.col(cuts), lambda c: (F.col(size) <= c["room"]) & (F.col(q) <= c["q"]))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 17, damping: float = 0.125, rounds: int = 3) -> DataFrame:
    """doc_id (named as key), size, source, source_size, target, copies, taken for every row of docs.

    size: words of the text, 0 for null or blank text (such rows get no copy). A null source is a
    source of its own, the last. Rows that repeat an id and a text have one rank and are taken together or not
    at all; other rows that share an id, or have none, are ranked apart. taken = copies * size, copies between 0
    and cap. The words of a source miss its target by less than half of the smallest document (or group of equal
    rows) passed over. Empty table: no rows. Sources are windowed one row each: millions of them fit a task.
    """
    return _mix(docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(source).alias("source")), [], weights, cap, seed, damping, rounds).select(
        F.col("key").alias(key), "size", F.col("source"), "source_size", "target", "copies", "taken"
    )


def _mix(docs: DataFrame, kept: list[str], weights: tuple[float, ...], cap: float, seed: int, damping: float, rounds: int) -> DataFrame:
    """key, source, the kept columns, and size, source_size, target, copies, taken. docs: key, text, source and kept ones."""
    k = F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)).cast("double"))).cast("int")
    base = docs.select("key", "source", *kept, word_count("text").alias("size"), uniform("key", "text", seed).alias("u")).withColumn("k", k)
    base = written(base, "mix-sizes")
    classes = base.groupBy("source", "k").agg(F.sum("size").alias("words"))
    t = source_targets(classes.select("source", F.col("words").alias("size")), weights, cap).select(F.col("source").alias("t_source"), "source_size", "target")
    rates = _class_rates(classes.join(t, _same("source", "t_source")), cap, damping)
    # whole copies of a class are certain: their words come off the target
    whole = F.floor(F.col("mu") + 1e-9)
    room = F.col("target") - F.sum(whole * F.col("words")).over(Window.partitionBy("source"))
    rates = written(rates.select(
        F.col("source").alias("r_source"), F.col("k").alias("r_k"), whole.alias("whole"), F.greatest(F.col("mu") - whole, F.lit(0.0)).alias("pi"), "source_size", "target", room.alias("room"),
    ), "mix-rates")
    rooms = rates.groupBy(F.col("r_source").alias("e_source")).agg(F.first("room").alias("room"))
    pi = F.greatest(F.least(F.col("pi"), F.lit(1 - 1e-12)), F.lit(1e-12))
    d = base.join(rates.drop("room"), _same("source", "r_source") & (F.col("k") == F.col("r_k")), "left")
    d = d.withColumn("q", (F.col("u") / (1 - F.col("u"))) / (pi / (1 - pi)))
    cuts = edges(d.select("source", "size", "pi", "q"), rooms, rounds)
    d = d.join(cuts, _same("source", "e_source"), "left")
    more = (F.col("pi") > 0) & (F.col("size") > 0) & F.coalesce(taken("size", "q", "cuts"), F.lit(False))
    copies = F.when(F.col("size") == 0, 0).otherwise(F.least(F.coalesce("whole", F.lit(0)) + more.cast("int"), F.lit(int(cap)))).cast("int")
    return d.select("key", "source", *kept, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """docs (with their text) that the mix takes at least once, and size, target, copies, taken (columns of those names are replaced).

    Rows are those of mix(): null ids, repeated ids and repeated rows are ranked as there, and every row is its own;
    null and blank texts are never taken; an empty table gives no rows. Other columns of any name pass through.
    """
    new = ("size", "target", "copies", "taken")
    names = [c for c in docs.columns if c.lower() not in new]
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)]).alias("row")
    options = {"weights": (5, 2, 1), "cap": 3.0, "seed": 17, "damping": 0.125, "rounds": 3} | options
    m = _mix(docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(source).alias("source"), row), ["row"], **options).where("copies > 0")
    return m.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)], *new)
