"""Cumulative-snapshot collapse: logged conversations that are prefixes of longer ones are dropped.

Every turn gets a rolling hash of the turns up to it: the sum of hashes of (position, role, text). A
conversation whose last rolling hash is another's earlier one is a prefix of it; anti-joins keep the
maximal ones, and of equal ones that with the smallest id. What remains is rendered turn by turn.

Positions and sums are prefix sums in two levels (chunks of CHUNK turn numbers, then turns within one), so
that a conversation with very many turns spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

CHUNK = 256


def _hash(seed: int, *columns: str) -> Column:
    """45 bits, so that sums of hundreds of thousands of turns stay exact; two of them make a key."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 19)


def _prefix(d: DataFrame, value: dict[str, Column], order: list[str]) -> DataFrame:
    """Adds running totals (this row included) per conversation, by chunk totals and sums within a chunk."""
    totals = d.groupBy("c", "chunk").agg(*[F.sum(v).alias(f"t_{k}") for k, v in value.items()])
    over = Window.partitionBy("c").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("c", "chunk", *[F.coalesce(F.sum(f"t_{k}").over(over), F.lit(0)).alias(f"b_{k}") for k in value])
    inside = Window.partitionBy("c", "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.join(totals, ["c", "chunk"])
    return d.select(*[x for x in d.columns if not x.startswith("b_")], *[(F.col(f"b_{k}") + F.sum(v).over(inside)).alias(k) for k, v in value.items()])


def rolling(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """c, pos (from 1), r, t, h1, h2: turns with their rolling hashes, written."""
    d = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("c"), F.coalesce(F.col(turn).cast("long"), F.lit(-1)).alias("n"),
        F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("t"),
    )
    d = d.withColumn("chunk", F.floor(F.col("n") / CHUNK)).withColumn("order", F.xxhash64("r", "t"))
    order = ["n", "order", "r", "t"]
    d = _prefix(d, {"pos": F.lit(1)}, order)
    return written(_prefix(d, {"h1": _hash(1, "pos", "r", "t"), "h2": _hash(2, "pos", "r", "t")}, order).select("c", "pos", "r", "t", "h1", "h2"), "turns")


def maximal(rolled: DataFrame) -> DataFrame:
    """c, n_turns of the conversations that are no prefix of a longer one; of equal ones the smallest id."""
    last = rolled.groupBy("c").agg(F.max("pos").alias("n_turns"))
    ends = rolled.join(last.withColumnRenamed("c", "e"), (F.col("c") == F.col("e")) & (F.col("pos") == F.col("n_turns")))
    ends = ends.groupBy("pos", "h1", "h2").agg(F.min("c").alias("c"))
    # a turn that is not its conversation's last: the prefix ending there is proper
    earlier = rolled.join(last.withColumnRenamed("c", "e"), (F.col("c") == F.col("e")) & (F.col("pos") < F.col("n_turns"))).select("pos", "h1", "h2").distinct()
    return ends.join(earlier, ["pos", "h1", "h2"], "left_anti").select("c", F.col("pos").alias("n_turns"))


def collapse(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, position, n_turns, role, rendered for every turn of the retained conversations.

    Turns are ordered by number (null first), then by content; repeated rows are turns of their own. Null
    role or text is empty. Rows without a conversation id are left out. Empty table: no rows.
    """
    rolled = rolling(turns, conv, turn, role, text)
    kept = written(maximal(rolled), "maximal").withColumnRenamed("c", "k")
    d = rolled.join(kept, F.col("c") == F.col("k"))
    rendered = F.concat(F.lit("<|"), F.col("r"), F.lit("|>\n"), F.col("t"), F.lit("\n<|end|>\n"))
    return d.select(F.col("c").alias(conv), F.col("pos").cast("long").alias("position"), F.col("n_turns").cast("long").alias("n_turns"), F.col("r").alias("role"), rendered.alias("rendered"))
