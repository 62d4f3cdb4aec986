"""Securities that are the same become one: every table that names them is rewritten by a mapping, as one new version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What must agree for two securities to be one.
AGREE = ("asset_class", "currency", "unit", "divisor")


def mergeable(securities: DataFrame, pairs: DataFrame, agree: tuple[str, ...] = AGREE) -> tuple[DataFrame, DataFrame]:
    """(mapping, conflicts) of pairs (source, target, rank): the pairs whose securities agree, and the others with the first field that doesn't.

    Nulls agree with nulls. A pair of equal or unknown securities is a conflict ('itself', 'unknown'). Targets must not be
    sources themselves; of several targets of a source the first by rank counts.
    """
    first = pairs.groupBy("source").agg(F.min(F.struct("rank", "target")).alias("x")).select("source", "x.target", "x.rank")
    s = securities.select(F.col("security_id").alias("source"), F.struct(*agree).alias("a"))
    t = securities.select(F.col("security_id").alias("target"), F.struct(*agree).alias("b"))
    d = first.join(s, "source", "left").join(t, "target", "left")
    differs = F.coalesce(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in agree])
    d = d.withColumn("conflict", F.when(F.col("source") == F.col("target"), "itself").when(F.col("a").isNull() | F.col("b").isNull(), "unknown").otherwise(differs))
    return d.where("conflict is null").select("source", "target", "rank"), d.where("conflict is not null").select("source", "target", "conflict")


def _moved(rows: DataFrame, mapping: DataFrame, column: str = "security_id") -> DataFrame:
    """rows with their column's target, and _rank: null for rows that were the target's already."""
    m = mapping.select(F.col("source").alias(column), F.col("target").alias("_target"), F.col("rank").alias("_rank"))
    d = rows.join(m, column, "left")
    return d.withColumn(column, F.coalesce("_target", column)).drop("_target")


def retargeted(rows: DataFrame, mapping: DataFrame, column: str = "security_id") -> DataFrame:
    """Every row names the target; nothing is dropped."""
    return _moved(rows, mapping, column).select(*rows.columns)


def retargeted_once(rows: DataFrame, mapping: DataFrame, key: list[str], column: str = "security_id") -> DataFrame:
    """Every row names the target; of rows that then share a key the target's own stays, else that of the first source by rank (ties: the smallest row)."""
    d = _moved(rows, mapping, column)
    other = [c for c in rows.columns if c not in key]
    order = F.struct(F.coalesce(F.col("_rank"), F.lit(-1)).alias("_r"), *other)
    return d.groupBy(*key).agg(F.min(order).alias("x")).select(*[F.col(c) if c in key else F.col(f"x.{c}").alias(c) for c in rows.columns])


def renumbered_lots(snapshots: DataFrame, mapping: DataFrame) -> DataFrame:
    """source, account_id, lot_seq, new_seq: where a source's lots go so that none meets a lot of the target or of a source before it.

    Sources follow by rank. In an account where the target has no lots yet a source keeps its numbers; else its lots
    are numbered in order from one above both.
    """
    lots = snapshots.select("account_id", "security_id", "lot_seq").distinct()
    own = lots.join(mapping.select(F.col("target").alias("security_id")).distinct(), "security_id").groupBy(F.col("security_id").alias("target"), "account_id").agg(F.max("lot_seq").alias("top"))
    m = lots.join(mapping, F.col("security_id") == F.col("source")).groupBy("target", "account_id", "source", "rank").agg(F.sort_array(F.collect_set("lot_seq")).alias("lots"))
    g = m.groupBy("target", "account_id").agg(F.sort_array(F.collect_list(F.struct("rank", "source", "lots"))).alias("sources")).join(own, ["target", "account_id"], "left")
    empty = F.array().cast("array<struct<source:bigint,lot_seq:int,new_seq:int>>")
    start = F.struct(F.col("top").cast("int").alias("top"), empty.alias("out"))

    def take(a: Column, s: Column) -> Column:
        least = F.greatest(a["top"], F.array_max(s["lots"])) + 1
        new = F.transform(s["lots"], lambda x, i: F.struct(s["source"].cast("long").alias("source"), x.cast("int").alias("lot_seq"), F.when(a["top"].isNull(), x.cast("int")).otherwise(least + i).cast("int").alias("new_seq")))
        top = F.when(a["top"].isNull(), F.array_max(s["lots"])).otherwise(least + F.size(s["lots"]) - 1)
        return F.struct(top.cast("int").alias("top"), F.concat(a["out"], new).alias("out"))

    return g.select("account_id", F.explode(F.aggregate("sources", start, take, lambda a: a["out"])).alias("x")).select("x.source", "account_id", "x.lot_seq", "x.new_seq")


def merged_snapshots(snapshots: DataFrame, mapping: DataFrame) -> DataFrame:
    """Snapshots of the targets, with their sources' lots under new numbers."""
    new = renumbered_lots(snapshots, mapping).withColumnRenamed("source", "security_id")
    d = snapshots.join(new, ["security_id", "account_id", "lot_seq"], "left").withColumn("lot_seq", F.coalesce("new_seq", F.col("lot_seq").cast("int"))).drop("new_seq")
    return retargeted(d.select(*snapshots.columns), mapping)


def merged_aliases(aliases: DataFrame, securities: DataFrame, mapping: DataFrame) -> DataFrame:
    """alias, security_id: aliases of the targets, with the names of sources and targets (the last source by rank wins an alias, a name over an older alias)."""
    old = _moved(aliases, mapping).select("alias", "security_id", F.coalesce(F.col("_rank"), F.lit(-1)).alias("_rank"), F.lit(0).alias("_new"))
    names = securities.where("name_key is not null and name_key <> ''").select("security_id", F.col("name_key").alias("alias"))
    sources = names.join(mapping, F.col("security_id") == F.col("source")).select("alias", F.col("target").alias("security_id"), F.col("rank").alias("_rank"), F.lit(1).alias("_new"))
    targets = names.join(mapping.groupBy(F.col("target").alias("security_id")).agg(F.max("rank").alias("_rank")), "security_id").select("alias", "security_id", "_rank", F.lit(1).alias("_new"))
    d = old.unionByName(sources).unionByName(targets)
    return d.groupBy("alias").agg(F.max_by("security_id", F.struct("_new", "_rank", "security_id")).alias("security_id"))


def merged_securities(securities: DataFrame, mapping: DataFrame) -> DataFrame:
    """The securities without the sources; a target without a code or without a price source takes that of its first source by rank that has one."""
    s = securities.join(mapping, F.col("security_id") == F.col("source"))
    linked = F.col("price_status").isin("linked", "manual")
    given = s.groupBy(F.col("target").alias("_t")).agg(F.min(F.when(F.col("code").isNotNull(), F.struct("rank", "code"))).alias("_c"), F.min(F.when(linked, F.struct("rank", "price_status", "price_ref"))).alias("_p"))
    d = securities.join(mapping.select(F.col("source").alias("security_id")), "security_id", "left_anti").join(given, F.col("security_id") == F.col("_t"), "left")
    takes = (F.col("price_status") == "unlinked") & F.col("_p").isNotNull()
    new = {"code": F.coalesce("code", "_c.code"), "price_ref": F.when(takes, F.col("_p.price_ref")).otherwise(F.col("price_ref")), "price_status": F.when(takes, F.col("_p.price_status")).otherwise(F.col("price_status"))}
    return d.select(*[new[c].alias(c) if c in new else F.col(c) for c in securities.columns])
