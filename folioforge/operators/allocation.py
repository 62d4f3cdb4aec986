"""Weighted tags and portfolios over holdings."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import comparable_name
from ..sources.domain import half_up

UNTAGGED = 0


def shares(holdings: DataFrame, weights: DataFrame) -> DataFrame:
    """A row per holding and tag with its share of the value, and one for the untagged rest of each holding.

    weights: security_id, tag_id, weight (percent). A null value counts as 0.
    """
    h = holdings.withColumn("value", F.coalesce("value", F.lit(0)))
    w = weights.withColumn("weight", F.least("weight", F.lit(100)))
    tagged = h.join(w, "security_id").withColumn("part", F.col("value") * F.col("weight") / 100.0)
    rest = h.join(w.groupBy("security_id").agg(F.sum("weight").alias("used")), "security_id", "left")
    rest = rest.withColumn("weight", F.greatest(100 - F.coalesce("used", F.lit(0)), F.lit(0))).where("weight > 0").withColumn("tag_id", F.lit(UNTAGGED).cast("long"))
    rest = rest.withColumn("part", F.col("value") * F.col("weight") / 100.0)
    names = [*holdings.columns, "tag_id", "weight", "part"]
    return tagged.select(*names).unionByName(rest.select(*names))


def portfolio_ratio(securities: DataFrame, weights: DataFrame, tags: list[int], include: Column, exclude: Column) -> DataFrame:
    """ratio of each security in a portfolio: excluded 0, included 1, else its matching weights, at most 1."""
    matched = weights.where(F.col("tag_id").isin(*tags)).groupBy("security_id").agg(F.sum("weight").alias("matched"))
    d = securities.join(matched, "security_id", "left")
    ratio = F.when(exclude, 0.0).when(include, 1.0).otherwise(F.least(F.coalesce("matched", F.lit(0)) / 100.0, F.lit(1.0)))
    return d.withColumn("ratio", half_up(ratio)).drop("matched")


def first_rule(items: DataFrame, rules: list[tuple[int, str, str, str]], text: str) -> DataFrame:
    """The first rule (ord, keyword pattern, exclude pattern, tag) that an item meets; null without one.

    Rules are a short ordered list, so they become one conditional expression: no join.
    """
    name = F.lower(text)
    rule = F.lit(None).cast("string")
    for _, keyword, exclude, tag in sorted(rules, reverse=True):
        hit = name.rlike(keyword) & ~(name.rlike(exclude) if exclude else F.lit(False))
        rule = F.when(hit, tag).otherwise(rule)
    return items.withColumn("rule_tag", rule)


class Rule(NamedTuple):
    """name; tags as (name, weight); letters of which one must be in a security's name, and none of which may be; classes that it is for; fallback: a guess by class."""

    name: str
    tags: tuple[tuple[str, float], ...]
    keywords: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()
    classes: tuple[str, ...] = ()
    fallback: bool = False


#: What names of funds and traded funds have (fixed values): a guess by class is doubtful for them.
FUND_MARKERS = ("etf", "etn", "上場", "連動型", "指数", "インデックス", "iシェアーズ", "ishares", "tracers", "グローバルx", "nextfunds", "nextnotes", "ファンド", "spdr", "maxis", "投信", "信託")


def matched_rules(securities: DataFrame, rules: list[Rule], codes: dict[str, str]) -> DataFrame:
    """securities (name, code, asset_class) with rule, matched_by, matched_value, doubtful.

    First a code that names a rule, then the rules in order: by a keyword (unless the name holds one of its excludes; its classes must fit), or, for rules
    without keywords, by class. doubtful: a guess by class for what is named like a fund. Null without a rule. Names are compared as
    likeness() compares them. Rules are a short list, so they become one conditional expression.
    """
    known, text, code = {r.name for r in rules}, comparable_name("name"), F.upper(F.trim("code"))
    found = lambda rule, by, value, doubt: F.struct(F.lit(rule).alias("rule"), F.lit(by).alias("matched_by"), value.alias("matched_value"), doubt.alias("doubtful"))
    has = lambda w: F.contains(F.col("_text"), F.lit(w))
    any_of = lambda ws: reduce(lambda a, b: a | b, [has(w) for w in ws], F.lit(False))
    out = F.lit(None)
    for r in reversed(rules):
        fits = ~any_of(r.excludes) & (F.col("asset_class").isin(*r.classes) if r.classes else F.lit(True))
        word = F.coalesce(*[F.when(has(w), F.lit(w)) for w in r.keywords]) if r.keywords else None
        by_class = found(r.name, "class", F.col("asset_class"), any_of(FUND_MARKERS) if r.fallback else F.lit(False))
        out = F.when(fits & word.isNotNull(), found(r.name, "keyword", word, F.lit(False))).otherwise(out) if r.keywords else F.when(fits, by_class).otherwise(out)
    for c, rule in codes.items():
        if rule in known:
            out = F.when(code == c, found(rule, "code", code, F.lit(False))).otherwise(out)
    d = securities.withColumn("_text", F.coalesce(text, F.lit(""))).withColumn("_x", out)
    return d.select(*securities.columns, "_x.rule", "_x.matched_by", "_x.matched_value", F.coalesce("_x.doubtful", F.lit(False)).alias("doubtful"))


def symbol_rule(symbol: Column, stable: tuple[str, ...], stable_rule: str, coin_rule: str) -> Column:
    """The rule of a coin by its symbol: stable or not; null for a blank one."""
    s = F.upper(F.trim(symbol))
    return F.when(s != "", F.when(s.isin(*stable), stable_rule).otherwise(coin_rule))


def suggestions(matched: DataFrame, rules: list[Rule], tags: DataFrame, current: DataFrame) -> DataFrame:
    """matched (security_id, rule, ...) with status, suggested, missing: what its rule's tags would change.

    tags: tag_id, name; current: security_id, tag_id, weight. status: no-rule, missing-tag (a tag's name is not there), new (nothing is stored), unchanged,
    change. suggested: (tag_id, weight), by tag; missing: names, in the rule's order.
    """
    spark = matched.sparkSession
    # one row for each tag of a rule
    wanted = spark.createDataFrame([(r.name, i, n, float(w)) for r in rules for i, (n, w) in enumerate(r.tags)], "rule string, at int, name string, weight double").join(tags.select(F.col("name"), F.col("tag_id").cast("long").alias("tag_id")), "name", "left")
    plan = wanted.groupBy("rule").agg(F.sort_array(F.collect_list(F.when(F.col("tag_id").isNotNull(), F.struct("tag_id", "weight")))).alias("suggested"), F.transform(F.sort_array(F.collect_list(F.when(F.col("tag_id").isNull(), F.struct("at", "name")))), lambda x: x["name"]).alias("missing"))
    now = current.groupBy("security_id").agg(F.sort_array(F.collect_list(F.struct(F.col("tag_id").cast("long").alias("tag_id"), F.col("weight").cast("double").alias("weight")))).alias("_now"))
    d = matched.join(plan, "rule", "left").join(now, "security_id", "left")
    status = F.when(F.col("rule").isNull(), "no-rule").when(F.size("missing") > 0, "missing-tag").when(F.col("_now").isNull(), "new").when(F.col("_now") == F.col("suggested"), "unchanged").otherwise("change")
    return d.withColumn("status", status).drop("_now")
