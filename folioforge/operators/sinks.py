"""Table rewrites of an import: each returns the table's new rows; the caller writes them as one new version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rolled_back(rows: DataFrame, links: DataFrame, batch: str, key: str = "dedup_key") -> DataFrame:
    """rows (key, batch_id, ...) after a batch is undone: its rows go unless another batch saw them too (links: key, batch_id, seen);
    then they belong to the batch that saw them earliest (links: seen, the link's time or number; ties: the smaller batch id)."""
    others = links.where(F.col("batch_id") != batch).groupBy(F.col(key).alias("_k")).agg(F.min(F.struct("seen", "batch_id")).alias("_first")).select("_k", F.col("_first.batch_id").alias("_owner"))
    d = rows.join(others, F.col(key) == F.col("_k"), "left")
    mine = F.col("batch_id") == batch
    d = d.where(~mine | F.col("_owner").isNotNull())
    return d.select(*[F.when(mine, F.col("_owner")).otherwise(F.col("batch_id")).alias(c) if c == "batch_id" else F.col(c) for c in rows.columns])


def replaced_statement(rows: DataFrame, new: DataFrame, account: str, date: str, zeroed: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """rows after a statement is committed: what the table has for the statement's accounts and dates goes, the statement's rows come,
    and the chosen missing lots (zeroed: keys) get a row of quantity 0."""
    there = new.select(account, date).distinct()
    kept = rows.join(there, [account, date], "left_anti")
    out = kept.unionByName(new)
    if zeroed is not None:
        day = new.agg(F.max(date).alias(date))
        gone = zeroed.join(new.select(*keys), list(keys), "left_anti").join(F.broadcast(day))
        out = out.unionByName(gone.select(*[F.lit(0).cast(rows.schema[c].dataType).alias(c) if c == "quantity" else F.col(c) for c in rows.columns]))
    return out


def replaced_derived(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A derived table after a recomputation: groups that are no longer there go, a group keeps its batch unless it gets one."""
    before = old.select(*keys, F.col("batch_id").alias("_batch"))
    return new.join(before, keys, "left").select(*[F.coalesce("batch_id", "_batch").alias(c) if c == "batch_id" else F.col(c) for c in new.columns])


def purged(previews: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """Previews of at most some hours' age; committed ones stay."""
    return previews.where((F.col("status") != "preview") | (F.col("created_at") >= F.lit(now).cast("timestamp_ntz") - F.make_interval(hours=F.lit(hours))))


def violations(rows: DataFrame, key: str, condition: str) -> DataFrame:
    """Values that a partial unique index would reject: key, n of the rows that meet the condition."""
    return rows.where(condition).where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
