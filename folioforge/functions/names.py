"""Names of funds and securities: cleaning, search words, likeness. Plain functions for tasks, and columns of them."""

from __future__ import annotations

import difflib
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How statements decorate names, what says whether a currency risk is hedged, words that any fund may have.
CODE = re.compile(r"[（(]\d{1,6}[）)]")
NICKNAME = re.compile(r"《[^《》]*》|【[^【】]*】")
NOTICE = re.compile(r"[<＜〈][^<>＜＞〈〉]*[>＞〉]")
INNER = re.compile(r"[（(]([^（）()]*)[）)]")
LAST_BRACKET = re.compile(r"[（(]((?:[^（）()]|[（(][^（）()]*[）)])*)[）)]\s*$")
WORD = re.compile(r"[A-Za-z0-9&+.\-]+|[^\sA-Za-z0-9&+.\-・/／()（）]+")
SEPARATORS = re.compile(r"[\s・･/／()（）]")
UNHEDGED = ("為替ヘッジなし", "ヘッジなし", "ヘッジ無", "H無", "Hなし")
HEDGED = ("為替ヘッジあり", "ヘッジあり", "ヘッジ有", "H有", "Hあり")
GENERIC = ("インデックスファンド", "投資信託", "インデックス", "ファンド", "オープン", "投信", "index", "fund")

#: Letters that a bracket and what precedes it share if it repeats the name; letters from which both are long enough for that.
SAME, LONG = 3, 4
#: Shared first letters from which they count as a brand; what differing hedges leave of a likeness.
BRAND, CLASH = 2, 0.3


def cleaned(name: str) -> str:
    """Compatibility form without codes, nicknames, notices and a bracket at the end that repeats the name."""
    s = NICKNAME.sub("", CODE.sub("", unicodedata.normalize("NFKC", name or ""))).strip()
    while (last := LAST_BRACKET.search(s)) is not None:
        body, inner = s[: last.start()].strip(), last[1]
        if min(len(body), len(inner)) < LONG or body[:SAME] != inner[:SAME]:
            break
        s = body
    return NOTICE.sub("", s).strip()


@lru_cache(maxsize=100_000)
def compared(name: str) -> str:
    """What a likeness looks at: the cleaned name in lower case without blanks, dots, slashes and brackets."""
    return SEPARATORS.sub("", cleaned(name).lower())


def words(name: str) -> list[str]:
    """Runs of one kind of letters outside of brackets, of two letters and more."""
    return [w for w in WORD.findall(INNER.sub(" ", cleaned(name))) if len(w) > 1]


def searches(name: str) -> list[str]:
    """What to search for, narrow to wide: five words, two, one, the longest ones, the longest's beginning; the name itself if it has no words."""
    ws = words(name)
    if not ws:
        return [cleaned(name)] if cleaned(name) else []
    by_length = sorted(ws, key=len, reverse=True)
    out = [" ".join(ws[:5])] + [" ".join(ws[:2])] * (len(ws) > 2) + ws[:1] * (len(ws) > 1) + [w for w in by_length[:2] if len(w) > 2] + [by_length[0][:3]] * (len(by_length[0]) > 3)
    return list(dict.fromkeys(out))


def hedge(name: str) -> str | None:
    s = unicodedata.normalize("NFKC", name or "")
    return "no" if any(w in s for w in UNHEDGED) else "yes" if any(w in s for w in HEDGED) else None


def blocks_ratio(a: str, b: str) -> float:
    """Share of letters in matching blocks; where one holds the other at least the ratio of their lengths."""
    ratio = difflib.SequenceMatcher(None, a, b).ratio()
    short, long = sorted((a, b), key=len)
    return max(ratio, len(short) / len(long)) if short in long else ratio


def likeness(a: str | None, b: str | None) -> float | None:
    """0 to 1, four digits; 0 if nothing is left of a name, null for a null. Different hedges take most of it."""
    if a is None or b is None:
        return None
    x, y = compared(a), compared(b)
    if not x or not y:
        return 0.0
    known = {hedge(a), hedge(b)}
    return round(blocks_ratio(x, y) * (CLASH if known == {"yes", "no"} else 1.0), 4)


def refined(a: str | None, b: str | None, base: float | None = None) -> float | None:
    """Likeness of what tells two names apart: without the beginning that they share (a brand can't tell) and without words
    that any fund may have. The plain likeness where nothing is left of one."""
    if a is None or b is None:
        return None
    base = likeness(a, b) if base is None else base
    x, y = compared(a), compared(b)
    block = difflib.SequenceMatcher(None, x, y).find_longest_match(0, len(x), 0, len(y))
    if block.a == block.b == 0 and block.size >= BRAND:
        x, y = x[block.size :], y[block.size :]
    for w in GENERIC:
        x, y = x.replace(w, ""), y.replace(w, "")
    return round(blocks_ratio(x, y), 4) if x and y else base


@F.pandas_udf(T.StringType())
def clean_name(name: pd.Series) -> pd.Series:
    return name.map(cleaned, na_action="ignore")


@F.pandas_udf(T.StringType())
def comparable_name(name: pd.Series) -> pd.Series:
    return name.map(compared, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def search_words(name: pd.Series) -> pd.Series:
    return name.map(searches, na_action="ignore")


@F.pandas_udf(T.StringType())
def hedge_marker(name: pd.Series) -> pd.Series:
    return name.map(hedge, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def name_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([likeness(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def refined_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([refined(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
