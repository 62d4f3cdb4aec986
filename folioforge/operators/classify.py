"""Rows of statements become transactions: type from the label, signs, checks inside the row, types of blank labels."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compatible
from ..sources.scratch import written
from .steps import split_ratio

# The words of transaction types as statements write them, after normalisation (see label_key).
REINVEST = ("再投資", "累投", "自動けいぞく投資", "自動継続投資", "reinvest")
RETURN_OF_CAPITAL = ("特別分配金", "元本払戻金", "元本払戻", "returnofcapital")
SPLIT = ("分割", "併合", "無償割当", "口数変更", "split")
DIVIDEND = ("配当", "分配金", "利金", "利息", "dividend", "distribution", "coupon")
SELL = ("売", "解約", "買取", "償還", "換金", "sell", "sold", "redemption")
BUY = ("買", "購入", "積立", "つみたて", "募集", "公募", "当初申込", "buy", "bought", "purchase", "ipo", "subscription")
TRANSFER_IN = ("入庫", "受入", "預入", "預り入", "transferin")
TRANSFER_OUT = ("出庫", "払出", "預出", "transferout")
CASH_IN = ("入金", "受取", "返金", "還付")
CASH_OUT = ("出金", "払戻", "支払", "徴収")
CASH_EITHER = ("振替", "資金移動", "transfer")
POINTS = ("ポイント換金", "ポイント交換", "マイル換金")
MARGIN = ("信用", "新規買", "新規売", "返済買", "返済売", "現引", "現渡", "建玉", "品受", "品渡")
DELIVERED, TAKEN = ("現渡", "品渡"), ("現引", "品受")
POSITION_WORD = ("建",)
MARKS = r"[\s　・･()（）\[\]【】｛｝{}/／\\,、.。:：;；_\-―ー–—]+"
UNIT = r"(円|株|口|％|%|グラム|g)$"
BRACKETS = r"[（(][^）)]*[）)]"

#: What doubts take off a row's confidence: arithmetic that fails, a field that is missing, an unknown type, a small thing.
FAILED, MISSING, UNKNOWN, MINOR = 0.35, 0.25, 0.2, 0.1
#: Money by which arithmetic may be off, rows that prove a reading, divisors of a unit price that are tried.
OFF, PROOF, DIVISORS = 1, 3, (1, 100, 10_000)
CASH = ("cash_in", "cash_out")
TRADES = ("buy", "sell", "reinvest")


def label_key(label: Column) -> Column:
    """Compatibility form, lower case, no blanks, marks or brackets, no unit at the end."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(compatible(label))), MARKS, ""), UNIT, "")


def _has(text: Column, *words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(re.escape(w) for group in words for w in group))


def _rules(text: Column) -> list[tuple[Column, str, float]]:
    """(condition, type, confidence) in the order in which they are tried."""
    trade, moved = _has(text, BUY, SELL), _has(text, TRANSFER_IN, TRANSFER_OUT)
    return [
        (_has(text, DELIVERED), "sell", 1.0), (_has(text, TAKEN), "buy", 1.0), (_has(text, MARGIN) & (trade | _has(text, POSITION_WORD)), "other", 0.0), (_has(text, REINVEST) & ~moved, "reinvest", 1.0),
        (_has(text, RETURN_OF_CAPITAL), "return_of_capital", 1.0), (_has(text, SPLIT) & ~trade, "split", 1.0), (_has(text, DIVIDEND) & ~trade, "dividend", 1.0), (_has(text, POINTS), "cash_in", 0.9), (_has(text, SELL), "sell", 1.0),
        (_has(text, BUY), "buy", 1.0), (_has(text, TRANSFER_IN), "transfer_in", 0.8), (_has(text, TRANSFER_OUT), "transfer_out", 0.8), (_has(text, CASH_OUT), "cash_out", 0.9), (_has(text, CASH_IN), "cash_in", 0.9), (_has(text, CASH_EITHER), "cash_in", 0.5),
    ]


def type_of(label: Column) -> Column:
    """struct(kind, sure): the type of a label; 'other' with 0 if no word is known. Null for a null label.

    What stands outside of brackets decides, if it says anything, since brackets hold additions; else the whole label.
    """

    def one(text: Column) -> Column:
        out = F.struct(F.lit("other").alias("kind"), F.lit(0.0).alias("sure"))
        for test, kind, sure in reversed(_rules(text)):
            out = F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(sure).alias("sure"))).otherwise(out)
        return out

    # an array of one binds the keys, so that they are built once
    keys = F.struct(label_key(F.regexp_replace(compatible(label), BRACKETS, "")).alias("head"), label_key(label).alias("whole"))
    found = F.transform(F.array(keys), lambda k: F.when(one(k["head"])["kind"] != "other", one(k["head"])).otherwise(one(k["whole"])))[0]
    return F.when(label.isNotNull(), found)


def is_margin(label: Column) -> Column:
    return F.coalesce(_has(label_key(label), MARGIN), F.lit(False))


def no_movement(columns: tuple[str, ...] = ("quantity", "gross_amount", "net_amount", "fee", "tax")) -> Column:
    """True if every quantity and amount, costs too, is null or 0."""
    empty = F.lit(True)
    for c in columns:
        empty = empty & (F.coalesce(F.col(c), F.lit(0)) == 0)
    return empty


def _once(d: DataFrame, **columns: Column) -> DataFrame:
    """d with columns that later ones use many times: inline() makes them rows' values, so that they aren't put into each use as text."""
    return d.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def transactions(rows: DataFrame) -> DataFrame:
    """The rows with kind, signed quantity and net, gross without sign, split_ratio, warnings, confidence, margin, off_market.

    rows: label, name, code, trade_date, settle_date, quantity, unit_price, price_text, gross, net, fee, tax,
    sign_convention (by_type, signed_quantity, signed_net or unsigned), divisor, confidence; other columns pass
    through. Amounts are doubles; a blank text counts as a null one.

    A trade day that is missing is the settlement day. Types that the label doesn't say follow from signs where the
    file's convention has them; transfers of cash of either direction and money reserve funds go by the amount's sign;
    a trade without a security and a quantity is cash. Margin trades are 'other' and marked. Every doubt is a warning
    and takes from the confidence.
    """
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    d = rows.withColumn("_label", F.when(~blank("label"), F.col("label")))
    # each label once: there are few of them, and their rules are many
    of_label = d.select("_label").where("_label is not null").distinct().withColumn("_t", type_of(F.col("_label")))
    mrf = lambda c: F.contains(F.lower(compatible(c)), F.lit("mrf"))
    of_label = written(of_label.select("_label", "_t", mrf(F.col("_label")).alias("_mrf"), is_margin(F.col("_label")).alias("_margin"), _has(F.col("_label"), DELIVERED, TAKEN).alias("_off")), "labels")
    d = d.join(of_label, "_label", "left").withColumn("_sure", F.coalesce("_t.sure", F.lit(0.0))).withColumn("_day", F.coalesce("trade_date", "settle_date"))
    q, net, gross = F.col("quantity"), F.col("net"), F.col("gross")
    by_sign = F.when((F.col("sign_convention") == "signed_quantity") & (q != 0), F.when(q > 0, "buy").otherwise("sell")).when((F.col("sign_convention") == "signed_net") & (net != 0), F.when(net < 0, "buy").otherwise("sell")).otherwise("other")
    said = F.coalesce("_t.kind", F.lit("other"))
    d = _once(d, _first=F.when((said == "other") & (F.col("sign_convention") != "by_type"), by_sign).otherwise(said))
    first, amount = F.col("_first"), F.coalesce(net, gross)
    direction = F.when(amount < 0, "cash_out").otherwise("cash_in")
    either = first.isin(*CASH) & (F.col("_sure") < 0.9) & amount.isNotNull()
    reserve = F.coalesce("_mrf", F.lit(False)) | F.coalesce(mrf(F.col("name")), F.lit(False))
    d = _once(d, _k=F.when(either | (~first.isin(*CASH) & reserve), direction).otherwise(first))
    no_security = blank("name") & blank("code")
    signed_net = F.when(F.col("_k").isin("buy", "reinvest", "cash_out"), -F.abs(net)).when(F.col("_k").isin("sell", "cash_in"), F.abs(net)).otherwise(net)
    d = _once(d, _cash=F.col("_k").isin(*TRADES) & no_security & (F.coalesce(q, F.lit(0.0)) == 0) & net.isNotNull(), _net=signed_net)
    kind = F.col("_k")
    moved = F.when(kind.isin("sell", "transfer_out"), -F.abs(q)).when(kind.isin("buy", "reinvest", "transfer_in"), F.abs(q)).when(kind.isin("dividend", "return_of_capital", *CASH), None).otherwise(q)
    final = F.when(F.col("_cash"), F.when(F.col("_net") < 0, "cash_out").otherwise("cash_in")).otherwise(kind)
    d = _once(d, kind=final, _q=F.when(~F.col("_cash"), moved), _g=F.abs(gross), margin=(kind == "other") & F.coalesce("_margin", F.lit(False)), off_market=F.coalesce("_off", F.lit(False)))
    size, price, by = F.abs("_q"), F.abs("unit_price"), F.col("divisor").cast("double")
    off_row = (size * price != 0) & (F.col("_g") != 0) & (F.abs(size * price / by - F.col("_g")) > OFF + size * 0.5 / by)
    costs = F.coalesce("fee", F.lit(0.0)) + F.coalesce("tax", F.lit(0.0))
    off_net = F.abs(F.abs(F.abs(F.col("_net")) - F.col("_g")) - costs) > OFF
    unknown, final = kind == "other", F.col("kind")
    lost = no_security & ~final.isin(*CASH)
    doubts = [
        ("settlement_day", F.col("trade_date").isNull() & F.col("settle_date").isNotNull(), 0.0), ("no_date", F.col("_day").isNull(), MISSING), ("margin", unknown & F.col("margin"), UNKNOWN), ("unknown_type", unknown & ~F.col("margin"), UNKNOWN),
        ("return_of_capital", kind == "return_of_capital", 0.0), ("cash", F.col("_cash"), -MISSING), ("no_security", lost, MISSING), ("no_quantity", final.isin(*TRADES) & F.col("_q").isNull(), MISSING), ("row", off_row, FAILED), ("net", off_net, MINOR),
    ]
    d = _once(d, **{f"_is_{name}": test for name, test, _ in doubts})
    doubts = [(name, F.col(f"_is_{name}"), x) for name, _, x in doubts]
    less = sum((F.when(test, x).otherwise(0.0) for _, test, x in doubts), F.lit(0.0))
    d = d.withColumn("warnings", F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test, _ in doubts]))).withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") - less)))
    d = d.withColumn("split_ratio", F.when((kind == "split") & (F.coalesce("unit_price", F.lit(0.0)) != 0), split_ratio(F.col("price_text"))))
    return d.withColumns({"trade_date": F.col("_day"), "quantity": F.col("_q"), "gross": F.col("_g"), "net": F.col("_net")}).select(*rows.columns, "kind", "margin", "off_market", "warnings", "split_ratio")


def blank_types(rows: DataFrame, order: str = "row_index") -> DataFrame:
    """The rows with the types that their files prove for blank labels: kind, signs, inferred ('balance', 'file' or null), warnings, confidence.

    rows: as transactions returns them, with file, has_type_column and order, which is unique in a file. A blank row
    that has the form of a trade (quantity x price / divisor meets the amount, for the file's divisor or a usual one) is
    a purchase if reading the name's blank rows as sales would sell what isn't there. Where PROOF rows of a file are
    proven, its other blank rows of that form are purchases too.

    The lowest running balance of a name is composed from months (sum, lowest prefix), so a name with very many rows
    is cut; proof is counted per file and joined back.
    """
    q, p = F.abs("quantity"), F.abs("unit_price")
    settled = F.coalesce("gross", F.abs("net"))
    fits = F.lit(False)
    for by in (F.col("divisor").cast("double"), *[F.lit(float(x)) for x in DIVISORS]):
        fits = fits | (F.abs(q * p / by - settled) <= OFF + (q * 0.5 + p) / by)
    unlabelled = F.col("label").isNull() | (F.trim("label") == "")
    form = (F.col("kind") == "other") & unlabelled & ~F.col("margin") & (q != 0) & (p != 0) & fits
    d = rows.withColumn("_blank", F.coalesce(form, F.lit(False)) & F.coalesce("has_type_column", F.lit(False)) & F.col("name").isNotNull() & (F.col("name") != ""))
    n = F.coalesce(q, F.lit(0.0))
    step = F.when(F.col("_blank") | F.col("kind").isin("sell", "transfer_out"), -n).when(F.col("kind").isin("buy", "reinvest", "transfer_in"), n).otherwise(0.0)
    key, day = ["file", "name"], F.coalesce("trade_date", F.lit("9999-12-31").cast("date"))
    walk = d.where("name is not null and name <> ''").select(*key, day.alias("_day"), F.trunc(day, "MM").alias("_m"), order, step.alias("_step"), "_blank")
    inside = Window.partitionBy(*key, "_m").orderBy("_day", order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    months = walk.withColumn("_run", F.sum("_step").over(inside)).groupBy(*key, "_m").agg(F.sum("_step").alias("s"), F.min("_run").alias("low"), F.count_if("_blank").alias("blank"))
    before = Window.partitionBy(*key).orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    names = months.withColumn("_low", F.col("low") + F.coalesce(F.sum("s").over(before), F.lit(0.0))).groupBy(*key).agg((F.min("_low") < 0).alias("_proven"), F.sum("blank").alias("blank")).where("blank > 0")
    files = names.groupBy("file").agg(F.sum(F.when(F.col("_proven"), F.col("blank")).otherwise(0)).alias("proof")).where(F.col("proof") >= PROOF)
    d = d.join(names.join(files.select("file"), "file", "left_semi").select(*key, "_proven"), key, "left")
    buy = F.col("_blank") & F.col("_proven").isNotNull()
    return d.withColumns({
        "inferred": F.when(buy, F.when(F.col("_proven"), "balance").otherwise("file")), "kind": F.when(buy, "buy").otherwise(F.col("kind")), "quantity": F.when(buy, F.abs("quantity")).otherwise(F.col("quantity")),
        "net": F.when(buy, -F.abs("net")).otherwise(F.col("net")), "warnings": F.when(buy, F.concat(F.array_remove("warnings", "unknown_type"), F.array(F.lit("inferred")))).otherwise(F.col("warnings")),
        "confidence": F.when(buy, F.least(F.lit(1.0), F.col("confidence") + UNKNOWN)).otherwise(F.col("confidence")),
    }).select(*rows.columns, "inferred")
