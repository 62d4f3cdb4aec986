"""Labels, amounts, dates, codes, names and blank types: the rules on small inputs, and plain versions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from folioforge.functions import names
from folioforge.functions import text as fx
from folioforge.operators import classify, matching, steps


def column(spark, values, f, kind="string"):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in d.withColumn("x", f(F.col("v"))).orderBy("i").select("x").collect()]


LABELS = {
    "分割売却": "sell", "分配金再投資": "reinvest", "投信（買付）": "buy", "ご入金（カード積立）": "cash_in", "信用新規買い": "other", "返済売り": "other", "現渡": "sell", "現引": "buy", "国内累投ＮＩＳＡ払出（特定へ）": "transfer_out", "ＢＵＹ": "buy", "株式併合": "split",
    "特別分配金": "return_of_capital", "振替入庫": "transfer_in", "振替入金": "cash_in", "自動振替出金": "cash_out", "振替（信用保証金へ）": "cash_in", "ポイント換金": "cash_in", "買取請求": "sell", "満期償還": "sell", "ﾊｲﾄｳ": "other", "": "other", "  ": "other", "Stock Split": "split", "Transfer In": "transfer_in",
}


def test_labels(spark):
    got = column(spark, [*LABELS, None], lambda c: classify.type_of(c)["kind"])
    assert got == [*LABELS.values(), None]
    assert column(spark, ["信用新規買い", "現渡", "買付", "建玉", None], classify.is_margin) == [True, True, False, True, False]


def test_codes(spark):
    raw = ["28400", "2840", "ABCDEF", " 28 40 ", "２８４０", "285A", "285a0", "12345", "", None, "1306"]
    assert column(spark, raw, fx.security_code) == ["2840", "2840", None, "2840", "2840", "285A", "285A", None, None, None, "1306"]
    assert column(spark, ["28400"], lambda c: fx.security_code(c, ("28400",))) == ["28400"]


def test_ratios(spark):
    assert column(spark, ["1:3", "1対1.5", "２：１", "3", "３", "1/3", "x", "0:2", "-1", None, "2:0"], steps.split_ratio) == [3.0, 1.5, 0.5, 3.0, 3.0, None, None, None, None, None, 0.0]


def test_amounts(spark):
    raw = ["1,234.5", "(1,234)", "-12", "▲１２円", "△3", "'7", "+5", "12%", "2,256ポイント", "−4", "--", "n/a", "", "x", None, "１，２３４口"]
    assert [None if v is None else float(v) for v in column(spark, raw, fx.amount)] == [1234.5, -1234.0, -12.0, -12.0, -3.0, 7.0, 5.0, 12.0, 2256.0, -4.0, None, None, None, None, None, 1234.0]


def test_dates(spark):
    d = dt.date
    raw = {"2024-1-5": d(2024, 1, 5), "2024年1月5日": d(2024, 1, 5), "２０２４／０１／０５": d(2024, 1, 5), "20240105": d(2024, 1, 5), "18991231": None, "令和6年1月5日": d(2024, 1, 5), "R6.1.5": d(2024, 1, 5), "平成元年1月8日": d(1989, 1, 8), "26/01/05": d(2026, 1, 5), "26/13/05": None, "31.12.2024": d(2024, 12, 31), "12/31/2024": d(2024, 12, 31), "3/4/2024": d(2024, 3, 4), "2024/01/05 09:00:12": d(2024, 1, 5), "2024-02-30": None, "x": None, "": None}
    assert column(spark, [*raw, None], fx.any_date) == [*raw.values(), None]
    assert column(spark, ["3/4/2024", "13/4/2024"], lambda c: fx.any_date(c, "dmy")) == [d(2024, 4, 3), d(2024, 4, 13)]


def test_names(spark):
    assert names.cleaned("青空・世界株・ファンド(為替ヘッジなし)(青空・世界株(為替ヘッジなし))") == "青空・世界株・ファンド(為替ヘッジなし)"
    assert names.cleaned("海鳴外国株(4711)<手数料なし>《愛称》") == "海鳴外国株"
    assert names.searches("Northstar Slim 米国株式(X&Y500)") == ["Northstar Slim 米国株式", "Northstar Slim", "Northstar", "Slim", "Nor"]
    assert names.searches("()") == ["()"] and names.searches("") == []
    assert names.likeness("", "") == 0.0 and names.likeness("a b", "A・B") == 1.0 and names.likeness(None, "a") is None
    assert names.likeness("世界株(ヘッジあり)", "世界株(ヘッジなし)") < 0.3
    a, b = "青空ニューアジアファンド", "青空・DC外国不動産インデックスファンド"
    assert names.refined(a, b) < names.likeness(a, b) and names.refined("abc", "abcd") == names.likeness("abc", "abcd")
    assert column(spark, ["x ヘッジ有", "Hなし", "y", None], names.hedge_marker) == ["yes", "no", None, None]
    pairs = spark.createDataFrame([("global fund", "global"), (None, "x")], "a string, b string")
    assert [r[0] for r in pairs.select(names.name_score("a", "b")).collect()] == [0.75, None]


def test_suggestions_lose_nothing(spark):
    rng = random.Random(4)
    some = ["".join(rng.choice("abcあいう ・") for _ in range(rng.randint(0, 9))) for _ in range(150)]
    many = ["".join(rng.choice("abcdあいう(") for _ in range(rng.randint(0, 9))) for _ in range(200)]
    frames = (spark.createDataFrame([(x,) for x in [*v, None, v[0]]], f"{c} string") for v, c in ((some, "name"), (many, "other")))
    got = {(r["name"], r["other"], r["score"], r["rank"]) for r in matching.suggested(*frames, best=3, blocks=3).collect()}
    expected = set()
    for x in set(some):
        best = sorted((-names.likeness(x, y), y) for y in set(many) if x != y and names.likeness(x, y) >= 0.5)[:3]
        expected |= {(x, y, -s, i + 1) for i, (s, y) in enumerate(best)}
    assert got == expected


ROW = "file string, row_index int, name string, trade_date date, quantity double, unit_price double, gross double, net double, divisor int, has_type_column boolean, label string, kind string, margin boolean, warnings array<string>, confidence double"


def plain_blanks(rows):
    """What each row of (file, row_index) becomes by the rule: balance, file or nothing."""
    out = {}
    for file in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == file]

        def blank(r):
            q, p, settled = abs(r[4] or 0), abs(r[5] or 0), r[6] if r[6] is not None else abs(r[7]) if r[7] is not None else None
            return bool(r[9] and r[2] and r[11] == "other" and not (r[10] or "").strip() and not r[12] and q and p and settled is not None and any(abs(q * p / v - settled) <= 1 + (q * 0.5 + p) / v for v in (r[8], 1, 100, 10_000)))

        proven, others = [], []
        for name in {r[2] for r in mine if r[2]}:
            balance, broke = 0.0, False
            for r in sorted((r for r in mine if r[2] == name), key=lambda r: (r[3] or dt.date.max, r[1])):
                q = abs(r[4] or 0)
                balance += -q if blank(r) or r[11] in ("sell", "transfer_out") else q if r[11] in ("buy", "reinvest", "transfer_in") else 0
                broke = broke or balance < 0
            (proven if broke else others).extend(r[:2] for r in mine if r[2] == name and blank(r))
        if len(proven) >= 3:
            out |= dict.fromkeys(proven, "balance") | dict.fromkeys(others, "file")
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_blank_types_equal_a_plain_walk(spark, seed):
    rng, rows = random.Random(seed), []
    for f in range(12):
        for i in range(rng.choice([3, 30, 80])):
            kind = rng.choice(["buy", "buy", "buy", "sell", "transfer_in", "other", "other", "dividend"])
            q, p = rng.choice([None, 0.0, -3.0, *[float(rng.randint(1, 9))] * 9]), rng.choice([None, *[12_000.0] * 9])
            gross = None if rng.random() < 0.1 else (abs(q or 0) * (p or 0) / rng.choice([1, 1, 1, 10_000, 7]))
            label = rng.choice([None, "", " ", "何か"]) if kind == "other" else kind
            rows.append((f"f{f}", i, rng.choice(["a", "b", "c", "d", "e", "f", "g", "", None]), rng.choice([None, dt.date(2020, rng.randint(1, 4), rng.randint(1, 5))]), q, p, gross, rng.choice([None, 50.0]), rng.choice([1, 10_000]), f % 5 != 4, label, kind, rng.random() < 0.05, ["unknown_type"], 0.9))
    expected = plain_blanks(rows)
    got = classify.blank_types(spark.createDataFrame(rows, ROW)).collect()
    assert len(got) == len(rows) and {(r.file, r.row_index): r.inferred for r in got if r.inferred} == expected
    assert set(expected.values()) == {"balance", "file"}
    for r in got:
        if r.inferred:
            assert r.kind == "buy" and r.quantity > 0 and (r.net is None or r.net < 0) and r.warnings == ["inferred"] and r.confidence == 1.0


def test_no_rows(spark):
    assert classify.blank_types(spark.createDataFrame([], ROW)).collect() == []


def test_empty_rows_by_costs(spark):
    d = spark.createDataFrame([(0.0, None, 0.0, None, 5.0), (None, None, None, 0.0, 0.0), (1.0, None, None, None, None)], "quantity double, gross_amount double, net_amount double, fee double, tax double")
    assert [r[0] for r in d.select(classify.no_movement()).collect()] == [False, True, False]
