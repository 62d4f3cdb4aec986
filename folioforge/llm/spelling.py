"""Spelling variants: words one edit apart, found in a forward and a reversed sorted dictionary.

One edit (a code point inserted, deleted or replaced) leaves the first or the last half of a word intact. Words that
share a half are a block: a shared prefix in the forward dictionary, a shared suffix in the reversed one. A skewed
block is subdivided: what is left of its words without the shared half is again one edit apart, and so keeps a half
of its own. What small blocks hold is verified.

Pairs of equal length and pairs whose lengths differ by one go by halves of their own, so that every subdivision makes
the rest shorter; at the end only one code point is left, and all words of a block are near each other.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, written

#: A word's runs, the fewest code points and occurrences of a word, the divisor of the deletions.
RUN, LEAST_LENGTH, LEAST_COUNT, DELETE = "[A-Za-zÀ-ÿ]{%d,}", 7, 2, 31
#: A form has this many times the occurrences of its variant.
RATIO = 10
#: A block with more pairs is subdivided.
PAIRS = 512


def dictionary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: the words of at least LEAST_LENGTH code points that occur LEAST_COUNT times over all texts.

    A word is a maximal run of letters with A-Z lower-cased; where DELETE divides the CRC-32 of `<key>:<run>`, one of
    its code points is left out. Null texts have no words; a null key is written as nothing; rows that repeat a key or
    a text all count.
    """
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.explode(F.regexp_extract_all(text, F.lit(RUN % LEAST_LENGTH), F.lit(0))).alias("r"))
    runs = runs.withColumn("r", F.translate("r", string.ascii_uppercase, string.ascii_lowercase))
    runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "k", "r").cast("binary")))
    at = (F.col("h") % F.length("r")).cast("int")
    less = F.concat(F.left(F.col("r"), at), F.substr(F.col("r"), at + 2))
    words = runs.select(F.when(F.col("h") % DELETE == 0, less).otherwise(F.col("r")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _divided(parts: DataFrame) -> DataFrame:
    """Every part once by the first half of its rest (forward dictionary) and once by the last (reversed dictionary).

    A part is a word with the range (lo, size) of it that its block doesn't share. short: the length of the shorter
    word of a pair; even: pairs of equal length.
    """
    s, even = F.col("short"), F.col("even")
    first = F.when(even, F.floor(s / 2)).otherwise(F.ceil(s / 2)).cast("int")
    last = F.when(even, F.ceil(s / 2)).otherwise(F.floor(s / 2) + 1).cast("int")

    def part(direction: str, shared: Column, start: Column, length: Column) -> Column:
        return F.struct(
            F.xxhash64("block", F.lit(direction), F.substr("word", start, length)).alias("block"), F.col("even"), (s - shared).alias("short"), F.col("long"),
            (F.col("lo") + (shared if direction == "forward" else 0)).alias("lo"), (F.col("size") - shared).alias("size"), F.col("word"), F.col("n"),
        )

    forward = part("forward", first, F.col("lo"), first)
    reversed_ = part("reversed", last, F.col("lo") + F.col("size") - last, last)
    return parts.select(F.explode(F.array(forward, reversed_)).alias("p")).select("p.*")


def near_pairs(words: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """a, b, a_n, b_n: every two words of (word, n) that differ by exactly one edit, once, in no particular order.

    word must be distinct and not null; empty words meet words of one code point. Blocks of at most `pairs` pairs are
    verified, larger ones subdivided, so that no block makes all pairs of many words; only blocks that can't be
    subdivided (one code point is left, all its pairs are near) are as large as the alphabet. Blocks go by 64-bit
    hashes: a collision adds pairs to verify and no result.
    """
    length = F.length("word")
    roles = [(True, length, False), (False, length, False), (False, length - 1, True)]
    parts = words.select(
        F.explode(F.array(*[F.struct(F.lit(e).alias("even"), s.alias("short"), F.lit(x).alias("long")) for e, s, x in roles])).alias("r"), "word", "n"
    ).select("r.*", F.lit(1).alias("lo"), length.alias("size"), "word", "n").where(F.col("short") >= 0)
    parts = parts.withColumn("block", F.xxhash64("even", "short"))
    divisible = F.col("short") >= F.when(F.col("even"), 2).otherwise(1)
    # a first division without a count: words of one length are always many
    parts = _divided(parts.where(divisible)).unionByName(parts.where(~divisible), allowMissingColumns=True)
    found, tables = [], []
    while True:
        count = parts.groupBy("block").agg(F.sum((~F.col("long")).cast("long")).alias("x"), F.sum(F.col("long").cast("long")).alias("y"), F.max("even").alias("e"))
        count = count.select("block", F.when(F.col("e"), F.col("x") * (F.col("x") - 1) / 2).otherwise(F.col("x") * F.col("y")).alias("pairs")).where(F.col("pairs") > 0)
        live = written(parts.join(count, "block").withColumn("heavy", divisible & (F.col("pairs") > pairs)).drop("pairs"), "blocks")
        small = live.where(~F.col("heavy"))
        x = small.where(~F.col("long")).select("block", "even", F.col("word").alias("a"), F.col("n").alias("a_n"))
        y = small.select("block", "even", "long", F.col("word").alias("b"), F.col("n").alias("b_n"))
        met = x.join(y, ["block", "even"]).where(F.when(F.col("even"), F.col("a") < F.col("b")).otherwise(F.col("long")) & (F.levenshtein("a", "b", 1) == 1))
        found.append(written(met.select("a", "b", "a_n", "b_n"), "near"))
        heavy = live.where("heavy").drop("heavy")
        tables.append(live)
        if heavy.isEmpty():
            break
        parts = _divided(heavy)
    forget(*tables)
    return reduce(DataFrame.union, found).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where following (word, form) ends. Steps double each round; forms must not run in circles."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        jump = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = written(at.join(jump, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        forget(at)
        if after.where("moved").isEmpty():
            return after.drop("moved")
        at = after.drop("moved")
        at.scratch_path = after.scratch_path


def variants(words: DataFrame, ratio: int = RATIO, pairs: int = PAIRS) -> DataFrame:
    """word, form, root, n, n_near, form_n: each word's near words counted, its form and the form's last form.

    The form is the near word of largest n (ties: the smallest word) if that n is at least ratio times the word's;
    ratio must be above 1, so that forms don't run in circles. Without a near word n_near is 0. Other columns of
    words are ignored; an empty table gives no rows.
    """
    words = written(words.select("word", "n"), "words")
    two = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    both = near_pairs(words, pairs).select(F.explode(two).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    most = -F.col("best.less")
    is_form = most >= ratio * F.col("n")
    rows = written(words.join(best, "word", "left").select(
        "word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, most).cast("long").alias("form_n")
    ), "variants")
    last = roots(rows.where(F.col("form").isNotNull()))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
