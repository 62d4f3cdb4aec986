"""Document fingerprints: bottom-k sketches of word shingles, from DataFrame functions only.

A shingle is five words in a row; its hash is the first 64 bits of its MD5 sum, as 16 hex digits. A text's sketch is
its k smallest distinct hashes, ascending. Sketches of parts merge into the sketch of the whole, and two of them
estimate resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hashes of a sketch, words of a shingle, hex digits of a hash.
K, SHINGLE, DIGITS = 128, 5, 16
BLANKS = r"[\x20\x09-\x0D]+"
#: Most stretches of ids that a table is cut into; what the driver and a broadcast hold is one row for each.
STRETCHES = 100_000
EMPTY = "array<string>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def word_list(text: Column) -> Column:
    """The words of a text (null: none), A-Z lower-cased."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, BLANKS), "")


def sketch(text: Column, k: int = K) -> Column:
    """The k smallest distinct shingle hashes, ascending. Fewer words than a shingle's are one shingle; no words, no hashes."""

    def hashed(s: Column) -> Column:
        return F.substring(F.md5(s), 1, DIGITS)

    def lowest(w: Column) -> Column:
        rolled = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: hashed(F.concat_ws(" ", *[w[i + j] for j in range(SHINGLE)])))
        whole = F.when(F.size(w) > 0, F.array(hashed(F.array_join(w, " ")))).otherwise(F.array().cast(EMPTY))
        return F.when(F.size(w) >= SHINGLE, F.slice(F.sort_array(F.array_distinct(rolled)), 1, k)).otherwise(whole)

    return _let(word_list(text), lowest)


def fingerprint(sketch: Column) -> Column:
    """The sketch as one string; empty for a text without words."""
    return F.array_join(sketch, "")


def parsed(fingerprint: Column) -> Column:
    """The sketch of a fingerprint; null is read as empty."""
    return F.regexp_extract_all(F.coalesce(fingerprint, F.lit("")), F.lit("[0-9a-f]{%d}" % DIGITS), F.lit(0))


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles in all shingles of both: exact where both together have at most k; 1 for two empty sketches."""
    return _let(merged(a, b, k), lambda u: F.when(F.size(u) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)))


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else from the k-th smallest hash."""
    share = (F.conv(F.element_at(s, -1), 16, 10).cast("double") + 1.0) / 2.0**64
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, at most 1; 1 for an empty a."""
    common = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def merge_groups(df: DataFrame, by: list[str], sketch: str, k: int = K) -> DataFrame:
    """by, sketch: the merged sketch of each group's rows (null keys are a group; groups without a hash are left out).

    Every hash of a group is counted once, and tasks keep only their k smallest of a group before the shuffle, so a
    group with a third of all rows burdens no task.
    """
    h = df.select(*by, F.explode(sketch).alias(sketch)).distinct()
    lowest = h.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(sketch))).where(F.col("_rank") <= k)
    return lowest.groupBy(*by).agg(F.sort_array(F.collect_list(sketch)).alias(sketch))


def _stretch(at: Column, tie: Column, bounds: list[int]) -> Column:
    """The stretch of an id: the number of bounds up to it, by halving; an id that is several bounds is spread over theirs by its tie."""
    if not bounds:
        return F.lit(0)
    edges, steps = F.lit(bounds), [2**i for i in reversed(range(len(bounds).bit_length()))]

    def below(test: Callable[[Column, Column], Column]) -> Column:
        return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda n, s: F.when(test(F.get(edges, n + s - 1), at), n + s).otherwise(n))

    upto, under = below(lambda e, x: e <= x), below(lambda e, x: e < x)
    part = (tie.cast("double") + 2.0**63) / 2.0**64
    return F.when(upto - under < 2, upto).otherwise(under + 1 + F.least(F.floor(part * (upto - under)).cast("int"), upto - under - 1))


def _rows_with_stretch(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(rows, echoes), both (stretch, echo, id, at, tie, text): the rows, and behind each stretch's last row the first of the next."""
    spark = docs.sparkSession
    parts = max(1, min(STRETCHES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    d = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.withColumn("at", F.coalesce("id", F.lit(2**63 - 1))).withColumn("tie", F.xxhash64("text"))
    ranks = [i / parts for i in range(1, parts)]
    bounds = d.agg(F.percentile_approx("at", ranks, max(10_000, 10 * parts)).alias("b")).first().b if ranks else []
    rows = d.withColumn("stretch", _stretch(F.col("at"), F.col("tie"), bounds or [])).withColumn("echo", F.lit(False))
    firsts = sorted((r.stretch, r.first.at, r.first.tie) for r in rows.groupBy("stretch").agg(F.min(F.struct("at", "tie")).alias("first")).collect())
    before = [(firsts[i - 1][0], at, tie) for i, (_, at, tie) in enumerate(firsts)]
    heads = spark.createDataFrame(before, "stretch int, at long, tie long")
    there = d.join(F.broadcast(heads), ["at", "tie"])
    echoes = there.groupBy("stretch").agg(*[F.first(c).alias(c) for c in ("id", "at", "tie", "text")]).withColumn("echo", F.lit(True))
    return rows, echoes.select(rows.columns)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """One row a document: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_distinct, in_next.

    The edited text has its last quarter of code points (rounded down) replaced by the first as many of the next
    document's text, by ascending key; the first document follows the last. near_*: resemblance of the document's
    sketch to the edited text's and the next document's; n_distinct: its estimated distinct shingles; in_next: the
    estimated share of them in the next document.

    Null texts are empty; null keys come last; rows that repeat a key follow each other by a hash of their text; equal
    rows all stay. A text without words has an empty fingerprint, whose likeness is 1 to another empty one and 0 to
    others. One document follows itself; an empty table gives no rows. Other columns are ignored, whatever their names.

    Texts are shuffled once: keys are cut into stretches at their quantiles, so that a window sees one stretch; the
    first document of the next stretch goes along with each as an echo. A key with a third of all rows is cut by its
    texts. Rows equal in key and text stand in one stretch.
    """
    rows, echoes = _rows_with_stretch(docs, key, text)
    w = Window.partitionBy("stretch").orderBy("echo", "at", "tie")
    d = rows.unionByName(echoes).withColumn("next_text", F.lead("text").over(w)).withColumn("sketch", sketch(F.col("text"), k))
    d = d.withColumn("next_sketch", F.lead("sketch").over(w)).where(~F.col("echo"))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    d = d.withColumn("edited", F.concat(F.left(F.col("text"), n - cut), F.left(F.col("next_text"), cut)))
    own, other, after = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return d.withColumn("edited_sketch", sketch(F.col("edited"), k)).select(
        F.col("id").alias(key), n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint(own).alias("fingerprint"), fingerprint(other).alias("edited_fingerprint"),
        resemblance(own, other, k).alias("near_edited"), resemblance(own, after, k).alias("near_next"), distinct_shingles(own, k).alias("n_distinct"), containment(own, after, k).alias("in_next"),
    )
