"""Landed files of price providers and statements as DataFrames.

A connector's download step only drops files in a folder; these functions turn their text into rows.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Market suffix of a ticker and its time zone; everything else trades in New York.
ZONES = {"T": "Asia/Tokyo", "L": "Europe/London"}


def equity_daily(files: DataFrame, body: str = "value") -> DataFrame:
    """symbol, date, price of chart documents {symbol, timestamps, closes}: epoch to the market's date, null closes skipped."""
    d = files.select(F.from_json(body, "symbol string, timestamps array<long>, closes array<double>").alias("j"))
    d = d.select(F.col("j.symbol").alias("symbol"), F.explode(F.arrays_zip(F.col("j.timestamps").alias("t"), F.col("j.closes").alias("c"))).alias("x"))
    zone = F.lit("America/New_York")
    for suffix, name in ZONES.items():
        zone = F.when(F.col("symbol").endswith(f".{suffix}"), name).otherwise(zone)
    date = F.to_date(F.from_utc_timestamp(F.timestamp_seconds(F.col("x.t")), zone))
    return d.where("x.c is not null and x.t is not null").select("symbol", date.alias("date"), F.col("x.c").alias("price"))


def fx_daily(files: DataFrame, target: str = "JPY", body: str = "value") -> DataFrame:
    """base, date, rate of documents {base, rates: {date: {currency: rate}}}."""
    d = files.select(F.from_json(body, "base string, rates map<string,map<string,double>>").alias("j"))
    d = d.select(F.col("j.base").alias("base"), F.explode("j.rates").alias("day", "quotes"))
    return d.select("base", F.try_to_date("day").alias("date"), F.col("quotes")[target].alias("rate")).where("rate is not null and date is not null")


def coin_daily(files: DataFrame, body: str = "value") -> DataFrame:
    """coin, date, price: the last tick of each UTC day of documents {coin, prices: [[milliseconds, price]]}."""
    d = files.select(F.from_json(body, "coin string, prices array<array<double>>").alias("j")).select(F.col("j.coin").alias("coin"), F.explode("j.prices").alias("x"))
    ms = F.get("x", F.lit(0)).cast("long")
    d = d.select("coin", ms.alias("ms"), F.get("x", F.lit(1)).alias("price")).where("ms is not null and price is not null")
    return d.groupBy("coin", F.to_date(F.timestamp_millis("ms")).alias("date")).agg(F.max_by("price", "ms").alias("price"))


#: Encodings that are tried in turn (fixed values); escape sequences tell the 7-bit one, which decodes as anything.
ENCODINGS = ("utf-8-sig", "cp932", "euc-jp")
ESCAPES = (b"\x1b$B", b"\x1b$@", b"\x1b(J")


def plausible(text: str) -> float:
    """Share of the non-ASCII characters that Japanese text has: kana, ideographs, full-width forms, its punctuation."""
    other = [c for c in text if ord(c) > 127]
    good = sum("\u3000" <= c <= "\u30ff" or "\u4e00" <= c <= "\u9fff" or "\uff01" <= c <= "\uff60" for c in other)
    half_width, private = sum("\uff61" <= c <= "\uff9f" for c in other), sum("\ue000" <= c <= "\uf8ff" for c in other)  # what wrong decodings are full of
    return (good - 0.5 * half_width - 2 * private) / len(other) if other else 1.0


def decoded(content: bytes, encodings: tuple[str, ...] = ENCODINGS) -> str:
    """By byte order mark, by escape sequences, as UTF-8, else in the encoding that gives the most plausible text."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            return content.decode(name, "replace")
    if any(e in content for e in ESCAPES):
        with contextlib.suppress(UnicodeDecodeError):
            return content.decode("iso-2022-jp")
    found = []
    for name in encodings:
        with contextlib.suppress(UnicodeDecodeError):
            text = content.decode(name)
            if name.startswith("utf-8"):
                return text
            found.append((plausible(text), -len(found), text))
    return max(found)[2] if found else content.decode("utf-8", "replace")


def text_lines(spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """file, line (from 0), value of text files of any of the encodings; Spark's readers know Unicode and Latin ones only."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                lines = decoded(content, encodings).splitlines()
                yield pd.DataFrame({"file": path, "line": range(len(lines)), "value": lines})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "file string, line long, value string")


def fund_nav(spark: SparkSession, path: str) -> DataFrame:
    """date, nav of comma-separated fund files; lines without a date or a number (the header) are left out."""
    d = text_lines(spark, path).select(F.from_csv("value", "day string, nav string").alias("x")).select("x.*")
    return d.select(F.try_to_date(F.regexp_replace("day", "[/.]", "-")).alias("date"), F.regexp_replace("nav", ",", "").try_cast("decimal(18,4)").alias("nav")).where("date is not null and nav is not null")


def file_kind(content: str = "content") -> Column:
    """csv, xlsx, xls, pdf or unknown, by the first bytes; a zip is a workbook if it has an xl/ folder, a text has no NUL."""
    head = F.hex(F.substring(F.col(content), 1, 8))
    raw = F.decode(F.col(content), "ISO-8859-1")  # one character for each byte
    return (
        F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304"), F.when(F.contains(raw, F.lit("xl/")), "xlsx").otherwise("unknown")).when(head.startswith("D0CF11E0A1B11AE1"), "xls")
        .when(F.octet_length(content) == 0, "unknown").when(F.substring(raw, 1, 512).contains("\x00"), "unknown").otherwise("csv")
    )


DELIMITERS = (",", "\t", ";", "|")


def delimiter_scores(lines: DataFrame, keys: list[str], line: str = "value") -> DataFrame:
    """Per file and delimiter: the share of lines with its most frequent field count (above one), and that count.

    Ties between field counts go to the larger.
    """
    counts = F.array(*[F.struct(F.lit(d).alias("delimiter"), F.size(F.split(F.col(line), "[" + d + "]")).alias("fields")) for d in DELIMITERS])
    d = lines.where(F.length(F.trim(line)) > 0).select(*keys, F.explode(counts).alias("x")).select(*keys, "x.*")
    d = d.groupBy(*keys, "delimiter", "fields").agg(F.count("*").alias("n"))
    d = d.groupBy(*keys, "delimiter").agg(F.max(F.struct("n", "fields")).alias("best"), F.sum("n").alias("lines"))
    return d.select(*keys, "delimiter", F.col("best.fields").alias("fields"), F.when(F.col("best.fields") > 1, F.col("best.n") / F.col("lines")).otherwise(0.0).alias("score"))
