"""Name, number and date functions for statements of any layout."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility form; Spark has no function for it."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def compatible(text: Column) -> Column:
    """Compatibility form of a text; only texts with other than ASCII characters go through the UDF."""
    other = text.rlike("[^\\x00-\\x7F]")
    return F.when(other, nfkc(F.when(other, text))).otherwise(text)


def name_key(name: Column) -> Column:
    """Key of a name: compatibility form, trailing (digits) off, lower case, no blanks or middle dots."""
    return F.regexp_replace(F.lower(F.regexp_replace(compatible(name), r"\s*\([0-9]+\)\s*$", "")), r"[\s·・]+", "")


def security_code(code: Column, known: tuple[str, ...] = ()) -> Column:
    """An exchange code in its four-character form, a digit and three digits or letters; null if it is none.

    Compatibility form, no blanks, upper case; of five characters that end in 0 the 0 goes; known codes stay as they are.
    """
    c = F.regexp_replace(F.upper(compatible(code)), r"\s+", "")
    short, valid = F.substring(c, 1, 4), "^[0-9][0-9A-Z]{3}$"
    out = F.when((F.length(c) == 5) & c.endswith("0") & short.rlike(valid), short).when(c.rlike(valid), c)
    return F.when(c.isin(*known), c).otherwise(out) if known else out


#: Words and signs of currencies (fixed values).
CURRENCIES = {"円": "JPY", "日本円": "JPY", "¥": "JPY", "米ドル": "USD", "ドル": "USD", "$": "USD", "US$": "USD", "ユーロ": "EUR", "€": "EUR", "ポンド": "GBP", "£": "GBP"}


def currency(word: Column) -> Column:
    """ISO code of a word, a sign or a code; null if it is none."""
    w = F.upper(F.trim(word))
    table = F.create_map(*[F.lit(x) for pair in CURRENCIES.items() for x in pair])
    return F.coalesce(table[w], F.when(w.rlike("^[A-Z]{3}$"), w))


#: What stands for no value, and units after a number (fixed values).
NO_VALUE = ("-", "‐", "―", "—", "–", "ー", "−", "--", "n/a", "na")
UNITS = "円|%|ポイント|マイル|コイン|口|株|g"
#: Years before the first one of an era, by its name and letter (fixed values).
ERAS = {"令和": 2018, "R": 2018, "平成": 1988, "H": 1988, "昭和": 1925, "S": 1925, "大正": 1911, "T": 1911, "明治": 1867, "M": 1867}
FIRST_YEAR = 1990


def amount(text: Column) -> Column:
    """A number from 1,234.50 / (1,234.50) / -12 / ▲１２円 / '7 / $5; null if it is none.

    Compatibility form, a unit at the end and commas off; brackets, a minus or a triangle make it negative.
    """
    t = F.regexp_replace(F.trim(compatible(text)), r"^'\s*", "")
    bracket = t.rlike(r"^\(.+\)$")
    t = F.regexp_replace(F.when(bracket, F.trim(F.regexp_extract(t, r"^\((.+)\)$", 1))).otherwise(t), r"^\+\s*", "")
    t = F.trim(F.regexp_replace(t, f"({UNITS})$", ""))
    fallen = t.rlike("^[▲△]")
    digits = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "^[▲△]", ""), "−", "-"), r"[,$\s]", "")
    value = F.when(digits.rlike(r"^-?([0-9]+(\.[0-9]*)?|\.[0-9]+)$") & ~F.lower(t).isin(*NO_VALUE), digits.cast("decimal(20,4)"))
    return F.when(bracket != fallen, -value).otherwise(value)


def any_date(text: Column, order: str = "ymd") -> Column:
    """A date from y-m-d, y/m/d, y年m月d日, yyyymmdd, an era (令和6年1月5日, R6.1.5), yy/m/d, or d.m.y and m/d/y; null if it is none.

    A time after it is left out. Of two short numbers before a year one above 12 is the day; else order (dmy or not)
    decides. Eight digits are a date from FIRST_YEAR to next year.
    """
    t = F.trim(compatible(text))
    t = F.when(t.rlike(r"[ T]\d{1,2}:"), F.regexp_extract(t, r"^([^ T]*)", 1)).otherwise(t)
    part = lambda pattern, i: F.regexp_extract(t, pattern, i).try_cast("int")
    day = lambda y, m, d: F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")
    whole = r"^(\d{4})\s*[-/.年]\s*(\d{1,2})\s*[-/.月]\s*(\d{1,2})\s*日?$"
    era = rf"^({'|'.join(ERAS)})\s*(元|\d{{1,2}})\s*[年.\-/]\s*(\d{{1,2}})\s*[月.\-/]\s*(\d{{1,2}})\s*日?$"
    compact = r"^(\d{4})(\d{2})(\d{2})$"
    short_year = r"^(\d{2})\s*[-/.]\s*(\d{1,2})\s*[-/.]\s*(\d{1,2})$"
    year_last = r"^(\d{1,2})\s*[-/.]\s*(\d{1,2})\s*[-/.]\s*(\d{2,4})$"
    bases = F.create_map(*[F.lit(x) for pair in ERAS.items() for x in pair])
    era_year = bases[F.regexp_extract(t, era, 1)] + F.coalesce(part(era, 2), F.lit(1))
    a, b, c = (part(year_last, i) for i in (1, 2, 3))
    year = F.when(F.length(F.regexp_extract(t, year_last, 3)) == 4, c).otherwise(2000 + c)
    day_first = ((a > 12) & (b <= 12)) | (~((b > 12) & (a <= 12)) & F.lit(order == "dmy"))
    plausible = part(compact, 1).between(FIRST_YEAR, F.year(F.current_date()) + 1)
    return (
        F.when(t.rlike(whole), day(part(whole, 1), part(whole, 2), part(whole, 3))).when(t.rlike(era), day(era_year, part(era, 3), part(era, 4)))
        .when(t.rlike(compact), F.when(plausible, day(part(compact, 1), part(compact, 2), part(compact, 3))))
        .when(t.rlike(short_year) & (part(short_year, 2) <= 12) & (part(short_year, 3) <= 31), day(2000 + part(short_year, 1), part(short_year, 2), part(short_year, 3)))
        .when(t.rlike(year_last), F.when(day_first, day(year, b, a)).otherwise(day(year, a, b)))
    )
