"""What the columns of an unknown table mean: arithmetic between them, date order, sign convention."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Candidate mappings are permutations of three columns: so many numeric columns at most.
NUMERIC_COLUMNS = 8


def arithmetic_roles(df: DataFrame, columns: list[str], divisors: tuple[int, ...] = (1, 10_000), tolerance: float = 0.005) -> DataFrame:
    """For every way to read three columns as quantity, price and amount: rows with all three, and how many of them
    meet quantity * price / divisor = amount. One pass over the table for all mappings."""
    if len(columns) > NUMERIC_COLUMNS:
        raise ValueError(f"at most {NUMERIC_COLUMNS} numeric columns")
    ways = [(q, p, a, d) for q, p, a in permutations(columns, 3) if columns.index(q) < columns.index(p) for d in divisors]

    def passes(q: str, p: str, a: str, d: int) -> Column:
        x, y, z = (F.col(c).cast("double") for c in (q, p, a))
        return F.abs(x * y / d - z) <= tolerance * F.greatest(F.abs(z), F.lit(1.0))

    full = lambda q, p, a: F.col(q).isNotNull() & F.col(p).isNotNull() & F.col(a).isNotNull()
    sums = df.agg(*[F.sum(full(q, p, a).cast("long")).alias(f"n{i}") for i, (q, p, a, _) in enumerate(ways)], *[F.sum(passes(*w).cast("long")).alias(f"k{i}") for i, w in enumerate(ways)])
    rows = F.array(*[F.struct(F.lit(q).alias("quantity"), F.lit(p).alias("price"), F.lit(a).alias("amount"), F.lit(d).cast("long").alias("divisor"), F.col(f"n{i}").alias("checked"), F.col(f"k{i}").alias("passed")) for i, (q, p, a, d) in enumerate(ways)])
    return sums.select(F.explode(rows).alias("x")).select("x.*")


def date_order(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """ymd, dmy, mdy or ambiguous for a column of three-part dates, from all of its values."""
    first, second, third = (F.regexp_extract(text, r"^(\d{1,4})[-/.](\d{1,2})[-/.](\d{1,4})$", i).try_cast("int") for i in (1, 2, 3))
    g = df.groupBy(*keys).agg(F.max(first).alias("a"), F.max(second).alias("b"), F.max(third).alias("c"), F.count(first).alias("parsed"))
    order = F.when(F.col("a") > 31, "ymd").when((F.col("a") > 12) & (F.col("b") <= 12), "dmy").when((F.col("b") > 12) & (F.col("a") <= 12), "mdy").otherwise("ambiguous")
    return g.select(*keys, order.alias("date_order"), "parsed")


def sign_convention(df: DataFrame, keys: list[str], quantity: str, amount: str) -> DataFrame:
    """signed_quantity, signed_amount or unsigned: which column says whether a trade is a purchase."""
    g = df.groupBy(*keys).agg(F.sum((F.col(quantity) < 0).cast("long")).alias("q"), F.sum((F.col(amount) < 0).cast("long")).alias("a"), F.count("*").alias("n"))
    return g.select(*keys, F.when((F.col("q") > 0) & (F.col("q") < F.col("n")), "signed_quantity").when((F.col("a") > 0) & (F.col("a") < F.col("n")), "signed_amount").otherwise("unsigned").alias("convention"), "n")
