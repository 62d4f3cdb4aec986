"""Statements as they arrive: the totals that a statement says against those of its rows, and what a row becomes in the books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_key, security_code
from .replay import NOTHING

#: Names that accounts and securities of a section get (fixed values).
CASH_NAME, COIN_NAME, PENSION_ACCOUNT = "現金・預金", "暗号資産", "年金"
#: Confidence that a row without an account's name keeps.
NO_ACCOUNT = 0.4
#: What a section's rows become: (asset class, unit, divisor). Rows of other sections aren't taken.
SECTIONS = {"deposit": ("cash", "currency", 1), "crypto": ("other", "currency", 1), "stock": ("stock", "share", 1), "fund": ("fund", "unit", 10_000), "pension": ("pension", "piece", 1), "point": ("point", "point", 1)}
#: Classes whose holdings aren't bought by trades.
NO_TRADES = ("cash", "point", "pension", "real_estate")


def section_totals(rows: DataFrame, sections: DataFrame) -> DataFrame:
    """batch, section, rows, computed, expected, ok of every section that a statement names or has rows of.

    rows: batch, section, value (null: unread); sections: batch, section, expected (null: not stated). A section without rows has the
    total 0, one of which no value could be read has none; ok is null where nothing was stated.
    """
    r = rows.groupBy("batch", "section").agg(F.count("*").alias("rows"), F.sum("value").alias("computed"))
    d = sections.select("batch", "section", "expected").join(r, ["batch", "section"], "full_outer").withColumn("rows", F.coalesce("rows", F.lit(0).cast("long")))
    d = d.withColumn("computed", F.when(F.col("rows") == 0, F.lit(0).cast(r.schema["computed"].dataType)).otherwise(F.col("computed")))
    ok = F.when(F.col("expected").isNotNull(), F.coalesce(F.col("computed") == F.col("expected"), F.lit(False)))
    return d.select("batch", "section", "rows", "computed", "expected", ok.alias("ok"))


def grand_totals(sections: DataFrame, grand: DataFrame, unread: DataFrame) -> DataFrame:
    """batch, computed, expected, ok, wrong_sections, unread: a statement's own total against the sum of its sections.

    sections as of section_totals; grand: batch, expected; unread: batch, lines that couldn't be read. Sections without a total
    don't add; without any there is none. ok is null where no total was stated.
    """
    g = sections.groupBy("batch").agg(F.sum("computed").alias("computed"), F.count_if(~F.col("ok")).alias("wrong_sections"))
    d = grand.select("batch", "expected").join(g, "batch", "full_outer").join(unread.groupBy("batch").agg(F.count("*").alias("unread")), "batch", "left")
    ok = F.when(F.col("expected").isNotNull(), F.coalesce(F.col("computed") == F.col("expected"), F.lit(False)))
    none = F.lit(0).cast("long")
    return d.select("batch", "computed", "expected", ok.alias("ok"), F.coalesce("wrong_sections", none).alias("wrong_sections"), F.coalesce("unread", none).alias("unread"))


def targets(holdings: DataFrame, known: tuple[str, ...] = ()) -> DataFrame:
    """What every row of a statement becomes: account, security and lot; rows of other sections are left out.

    holdings: ref, section, name, code, institution, quantity, avg_cost, price, value, point_type, expiry, confidence. Deposits and coins are
    one security each, a lot by name, whose quantity is the value; a pension is one piece at its whole cost in an account of
    its own; a point's lot is its type and expiry. A stock with a valid code is linked to its price series.
    A row that needs an account's name and has none keeps little confidence and says so.
    """
    at = lambda i: F.create_map(*[F.lit(x) for s, v in SECTIONS.items() for x in (s, v[i])])[F.col("section")]
    s = lambda *names: F.col("section").isin(*names)
    code = F.when(s("stock"), security_code(F.col("code"), known))
    pooled = s("deposit", "crypto")
    name = F.when(s("deposit"), CASH_NAME).when(s("crypto"), COIN_NAME).otherwise(F.col("name"))
    nameless = ~s("pension") & (F.trim(F.coalesce("institution", F.lit(""))) == "")
    label = F.when(pooled, F.col("name")).when(s("point"), F.concat_ws("|", F.coalesce(F.when(F.col("point_type") != "", F.col("point_type")), F.col("name")), F.when(F.col("expiry") != "", F.col("expiry"))))
    quantity = F.when(pooled, F.col("value")).when(s("pension"), 1.0).otherwise(F.col("quantity"))
    d = holdings.where(s(*SECTIONS)).withColumn("_code", code)
    linked = F.col("_code").isNotNull()
    return d.select(
        "ref", "section", F.when(s("pension"), PENSION_ACCOUNT).otherwise(F.col("institution")).alias("account"), name.alias("name"), name_key(name).alias("name_key"), F.col("_code").alias("code"),
        at(0).alias("asset_class"), at(1).alias("unit"), at(2).alias("divisor"), F.when(linked, "series").otherwise("none").alias("source"), F.concat("_code", F.lit(".T")).alias("source_ref"),
        F.when(linked, "linked").when(s("stock", "fund"), "unlinked").otherwise("not required").alias("status"), label.alias("lot_label"), quantity.alias("quantity"),
        F.when(s("stock", "fund", "pension"), F.col("avg_cost")).alias("avg_cost"), F.when(s("stock", "fund"), F.col("price")).alias("reported_price"), F.col("value").alias("reported_value"),
        F.when(nameless, F.least("confidence", F.lit(NO_ACCOUNT))).otherwise(F.col("confidence")).alias("confidence"), nameless.alias("no_account"),
    )


def carried_back(paths: DataFrame, snapshots: DataFrame, instruments: DataFrame, basis: DataFrame) -> DataFrame:
    """account_id, security_id, quantity, until, unit_price, acquired_on: quantities that are drawn back beyond any record, and so may be filled in.

    paths as of quantity_paths; snapshots: account_id, security_id, lot_seq, as_of_date, quantity, avg_cost, acquired_on; instruments: security_id,
    asset_class; basis: account_id, security_id, residual_cost. A traced path carries its opening quantity back, until its first change, at the
    cost of what was bought before; a position without earlier trades the quantity of its first statement, at its mean cost where all lots
    have one, if its lots start on one day. acquired_on: the day that all lots of the first statement say, if before `until`. Destinations
    of transfers, positions that don't fit and classes without trades have no row.
    """
    keys: list[Column | str] = ["account_id", "security_id"]
    w = snapshots.groupBy(*keys).agg(F.min("as_of_date").alias("_first"))
    starts = snapshots.groupBy(*keys, "lot_seq").agg(F.min("as_of_date").alias("_s")).groupBy(*keys).agg((F.min("_s") == F.max("_s")).alias("_together"))
    at_first = snapshots.join(w, keys).where("as_of_date = _first").groupBy(*keys).agg(
        F.min("_first").alias("_first"), F.sum(F.col("quantity").cast("double")).alias("_held"), F.sum(F.col("quantity") * F.col("avg_cost").cast("double")).alias("_cost"), F.count_if(F.col("avg_cost").isNull()).alias("_costless"),
        F.min("acquired_on").alias("_a0"), F.max("acquired_on").alias("_a1"), F.count_if(F.col("acquired_on").isNull()).alias("_undated"),
    )
    tradable = instruments.where(~F.col("asset_class").isin(*NO_TRADES)).select("security_id")
    d = paths.join(tradable, "security_id", "left_semi").join(at_first, keys, "left").join(starts, keys, "left").join(basis.select(*keys, "residual_cost"), keys, "left")
    walked = F.col("status").isin("traced", "closed") & (F.col("opening") > NOTHING)
    held = F.col("status").isin("no_trades", "no_earlier_trades") & F.col("_together") & (F.col("_held") > 0)
    until = F.when(walked, F.coalesce(F.get("changes", F.lit(0))["day"], F.col("before"))).otherwise(F.col("_first"))
    price = F.when(walked, F.when(F.col("residual_cost") != 0, F.col("residual_cost"))).when(F.col("_costless") == 0, F.col("_cost") / F.col("_held"))
    same = F.when((F.col("_a0") == F.col("_a1")) & (F.col("_undated") == 0), F.col("_a0"))
    d = d.where(walked | held).select(*keys, F.when(walked, F.col("opening")).otherwise(F.col("_held")).alias("quantity"), until.alias("until"), price.alias("unit_price"), same.alias("_day"))
    return d.select(*keys, "quantity", "until", "unit_price", F.when(F.col("_day") < F.col("until"), F.col("_day")).alias("acquired_on"))
