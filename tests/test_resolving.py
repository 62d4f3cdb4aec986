"""Links of unknown names, coverage of fetches, prices now, statement totals: rules on small inputs, and plain versions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from folioforge.operators import fetching, linking, statements

D = dt.date
ROW = "row int, name string, code string, security_id long, kind string, margin boolean, still boolean, off_market boolean, quantity double, trade_date date, unit_price double"


def rows(spark, found):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(found)], ROW)


def test_code_forms(spark):
    d = spark.createDataFrame([(i, c) for i, c in enumerate(["012340000", "12340", " 1234 ", "", None, "285A", "ABCDEF", "0123400001"])], "i int, c string")
    got = [sorted(r[0]) if r[0] is not None else None for r in d.orderBy("i").select(linking.code_keys(F.col("c"))).collect()]
    assert got == [["012340000", "1234"], ["1234", "12340"], ["1234"], [], [], ["285A"], ["ABCDEF"], ["0123400001"]]


def test_category_conflicts(spark):
    pairs = [("国内株式a", "外国債券b", True), ("国内株式", "日本株式", False), ("先進国株式", "新興国株式", True), ("株式債券", "リート", False), ("x", "国内株式", False), (None, "国内株式", False), ("米国reit", "米国リート", False), ("日本先進国債券", "新興国債券", False)]
    d = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    assert [r[0] for r in d.orderBy("i").select(linking.category_conflict(F.col("a"), F.col("b"))).collect()] == [x for *_, x in pairs]


def plain_keys(code):
    c = (code or "").strip()
    return ({c} | ({c[1:5]} if len(c) == 9 and c[0] == "0" and c.endswith("0000") else set()) | ({c[:4]} if len(c) == 5 and c.endswith("0") else set())) if c else set()


def test_groups_and_links(spark):
    """Entries, groups and decisions against a plain version, over random rows."""
    rng = random.Random(11)
    found = []
    for _ in range(500):
        name = rng.choice(["", None, *[f"n{i}" for i in range(40)]])
        code = rng.choice([None, "", *[None] * 12, f"{rng.randrange(60):04d}", f"0{rng.randrange(60):04d}0000", f"{rng.randrange(60):04d}0"])
        sid = rng.choice([None] * 8 + [rng.randrange(6)])
        found.append((name, code, sid, rng.choice(["buy", "sell", "other", "cash_in", "dividend", "buy", "buy"]), rng.choice([False, None, False, True]), rng.random() < 0.2, False, float(rng.randint(-3, 6)), rng.choice([None, D(2020, 1, rng.randint(1, 9))]), 5.0))
    d = rows(spark, found)
    known = [r for r in found if r[2] is not None and r[0] and r[3] != "cash_in"]
    resolved = {}
    for r in known:
        for k in plain_keys(r[1]):
            resolved.setdefault(k, r[2])
    unknown = [r for r in found if r[2] is None and r[0] and r[3] != "cash_in" and not r[4]]
    names = {r[0] for r in unknown if not r[5]}
    keys = {n: set().union(*[plain_keys(r[1]) for r in unknown if r[0] == n]) for n in names}
    groups = []
    for n in sorted(names):
        same = [g for g in groups if any(keys[n] & keys[m] for m in g)]
        groups = [g for g in groups if g not in same] + [{n}.union(*same)]
    expected, last = {}, {n: max((r[8] for r in unknown if r[0] == n and not r[5] and r[8]), default=None) for n in names}
    for g in groups:
        primary = min(g, key=lambda n: (last[n] is None, -(last[n] or D(1, 1, 1)).toordinal(), n))
        mine = [r for r in unknown if r[0] in g and not r[5]]
        by_code = {resolved[k] for n in g for k in keys[n] if k in resolved}
        expected[primary] = (len(g), len(mine), sum(r[3] == "other" for r in mine), sum(r[7] for r in mine if r[3] != "other"), by_code)

    name_keys, entries = linking.name_keys(d), linking.entries(d)
    members, summed = linking.merged_by_code(entries, name_keys)
    got = {r.group: (r.names, r.rows, r.undetermined, r.net_quantity) for r in summed.collect()}
    assert got == {k: v[:4] for k, v in expected.items()}
    assert {r.name: r.group for r in members.collect()}.keys() == names

    cand = [(g, s, c, m) for g in expected for s, c, m in rng.sample([(50, 4, 4), (51, 3, 3), (52, 2, 2), (53, 30, 28), (54, 30, 20), (55, 0, 0)], 2)]
    held, holdings = {50, 53}, [(60 + i, float(i % 9)) for i in range(12)] + [(90, 17.0)]
    links = linking.decided(summed, members, name_keys, linking.resolved_keys(d, "row"), spark.createDataFrame(cand, "group string, security_id long, checked long, matched long"), spark.createDataFrame([(h,) for h in held], "security_id long"), spark.createDataFrame(holdings, "security_id long, quantity double"), spark.createDataFrame([(r[2],) for r in known], "security_id long"))
    want = {}
    for g, (_, _, _, _, by_code) in expected.items():
        sure = {s for x, s, c, m in cand if x == g and m >= 3 and (m == c or (c >= 20 and m >= 0.9 * c))}
        want[g] = (by_code.pop(), "code") if len(by_code) == 1 else (min(sure), "price") if len(sure) == 1 else (min(sure & held), "account") if len(sure) > 1 and len(sure & held) == 1 else (None, "ambiguous" if sure else "none")
    taken = {s for s, _ in want.values() if s is not None} | {r[2] for r in known}
    free = [(s, q) for s, q in holdings if s not in taken]
    open_ = [g for g, (s, _) in want.items() if s is None and expected[g][2] == 0 and expected[g][3] > 0]
    for g in open_:
        q = expected[g][3]
        if sum(expected[x][3] == q for x in open_) == 1 and sum(y == q for _, y in free) == 1:
            want[g] = (next(s for s, y in free if y == q), "quantity")
    assert {r.group: (r.security_id, r.how) for r in links.collect()} == want
    assert {"code", "price", "none"} <= {h for _, h in want.values()}


def test_prices_of_the_day_or_the_next_session(spark):
    day = D(2021, 1, 29)
    series = spark.createDataFrame([(1, day, 100.0), (1, D(2021, 2, 1), 110.0), (2, D(2021, 2, 3), 100.0)], "security_id long, date date, price double")
    prices = spark.createDataFrame([("g", day, 101.0, 2), ("g", day, 109.0, 1), ("g", day, 50.0, 1), ("g", D(2020, 5, 5), 100.0, 7)], "group string, trade_date date, unit_price double, n long")
    got = {r.security_id: (r.checked, r.matched, r.shifted) for r in linking.weighed(spark.createDataFrame([("g", 1), ("g", 2), ("h", 1)], "group string, security_id long"), prices, series).where("group = 'g'").collect()}
    assert got == {1: (4, 3, True), 2: (0, 0, False)}


def test_closed_securities(spark):
    found = [(0, "a", "x", 10.0, 20.0, 200.0, None, "USD"), (1, "a", "12340", 10.0, 20.0, 0.0, -200.0, ""), (2, "a", "5678", None, 1.0, 1.0, 1.0, None), (3, "b", None, 50_000.0, 10_000.0, 50_000.0, None, "EUR"), (4, "b", "", 1.0, 1.0, None, None, "USD"), (5, "c", None, 2.0, 2.0, 9.0, 9.0, "USD")]
    d = spark.createDataFrame(found, "row int, name string, code string, quantity double, unit_price double, gross double, net double, currency string")
    got = {r.name: (r.code, r.asset_class, r.unit, r.divisor, r.currency) for r in linking.closed_securities(d, "row").collect()}
    assert got == {"a": ("1234", "stock", "share", 1, "JPY"), "b": (None, "fund", "unit", 10_000, "EUR"), "c": (None, "other", "share", 1, "USD")}
    assert linking.closed_securities(d.limit(0), "row").count() == 0


def days(start, end):
    return {start + dt.timedelta(i) for i in range((end - start).days + 1)}


def test_gaps_and_coverage(spark):
    """Gaps, plan and what is recorded, against sets of days."""
    rng = random.Random(3)
    day = lambda: D(2022, 1, 1) + dt.timedelta(rng.randrange(60))
    names = [(s, str(i)) for s in ("fund", "equity") for i in range(8)]
    def some(n):
        out = []
        for _ in range(n):
            a, b = day(), day()
            out.append((*rng.choice(names), min(a, b), max(a, b) if rng.random() < 0.9 else min(a, b) - dt.timedelta(2)))
        return out
    wanted, covered = some(30), some(40)
    covered = [(s, r, a, min(b, a + dt.timedelta(12))) for s, r, a, b in covered]
    today = D(2022, 6, 1)
    attempts = [(*n, rng.choice([today, today - dt.timedelta(1)]), rng.random() < 0.5) for n in names if rng.random() < 0.6]
    kind = "source string, ref string, start_date date, end_date date"
    w, c, a = spark.createDataFrame(wanted, kind), spark.createDataFrame(covered, kind), spark.createDataFrame(attempts, "source string, ref string, attempted_on date, ok boolean")
    have = {n: set().union(*[days(x, y) for s, r, x, y in covered if (s, r) == n and x <= y]) for n in names}
    want = {n: set().union(*[days(x, y) for s, r, x, y in wanted if (s, r) == n and x <= y]) for n in names}
    found = fetching.gaps(w, c).collect()
    assert {n: set().union(*[days(g.gap_start, g.gap_end) for g in found if (g.source, g.ref) == n]) for n in names} == {n: want[n] - have[n] for n in names}
    assert sum((g.gap_end - g.gap_start).days + 1 for g in found) == sum(len(want[n] - have[n]) for n in names)

    skip = {(s, r) for s, r, on, ok in attempts if on == today and (not ok or s == "fund")}
    plan = fetching.fetch_plan(w, c, a, F.lit(today)).collect()
    for n in names:
        mine, left = [p for p in plan if (p.source, p.ref) == n], want[n] - have[n]
        if n in skip or not left:
            assert not mine
        elif n[0] == "fund":
            assert [(p.gap_start, p.gap_end) for p in mine] == [(min(left), max(left))]
        else:
            assert set().union(*[days(p.gap_start, p.gap_end) for p in mine]) == left
    got = [(p.source, p.ref, p.gap_start, p.gap_start) for p in plan[::2]]
    ranges, tried = fetching.recorded(c, a, spark.createDataFrame(plan), spark.createDataFrame(got, kind), F.lit(today))
    after = {n: set().union(have[n], *[{x} for s, r, x, _ in got if (s, r) == n]) for n in names}
    found = ranges.collect()
    assert {n: set().union(*[days(g.start_date, g.end_date) for g in found if (g.source, g.ref) == n]) for n in names} == after
    planned, fetched = {(p.source, p.ref) for p in plan}, {(s, r) for s, r, _, _ in got}
    assert {(r.source, r.ref): (r.attempted_on, r.ok) for r in tried.collect()} == {(s, r): (on, ok) for s, r, on, ok in attempts} | {n: (today, n in fetched) for n in planned}


def test_composable(spark):
    wanted = spark.createDataFrame([("XAU", "GC", "USD", D(2022, 1, 3), D(2022, 1, 6)), ("XAU", "GC", "USD", D(2022, 2, 1), D(2022, 2, 2)), ("XAG", "SI", "USD", D(2022, 1, 3), D(2022, 1, 6))], "ref string, future string, currency string, gap_start date, gap_end date")
    covered = spark.createDataFrame([("future", "GC", D(2022, 1, 1), D(2022, 1, 31)), ("future", "GC", D(2022, 2, 1), D(2022, 2, 1)), ("fx", "USD", D(2022, 1, 1), D(2022, 3, 1)), ("future", "SI", D(2022, 1, 1), D(2022, 1, 31))], "source string, ref string, start_date date, end_date date")
    futures = spark.createDataFrame([("GC", D(2022, 1, 4)), ("GC", D(2022, 2, 1)), ("SI", D(2022, 1, 3)), ("SI", D(2022, 1, 5))], "ref string, date date")
    at = lambda *ds: {(r.ref, r.gap_start.month): (r.ready, r.composed) for r in fetching.composable(wanted, covered, futures, spark.createDataFrame([("USD", x) for x in ds] or [("EUR", D(2022, 1, 1))], "ref string, date date")).collect()}
    assert at(D(2021, 12, 28)) == {("XAU", 1): (True, 1), ("XAU", 2): (False, 1), ("XAG", 1): (True, 2)}
    assert at(D(2022, 1, 4), D(2021, 12, 1)) == {("XAU", 1): (True, 1), ("XAU", 2): (False, 1), ("XAG", 1): (False, 1)}
    assert at() == {("XAU", 1): (False, 0), ("XAU", 2): (False, 0), ("XAG", 1): (False, 0)}


def test_spots(spark):
    p = "source string, ref string, price double, currency string"
    daily = spark.createDataFrame([("fund", "F", D(2022, 1, 1), 1.0, None), ("fund", "F", D(2022, 1, 2), 2.0, None), ("equity", "E", D(2022, 1, 1), 3.0, "USD"), ("equity", "Q", D(2022, 1, 1), 3.0, "USD"), ("manual", "7", D(2022, 1, 1), 40.0, "JPY")], "source string, ref string, date date, price double, currency string")
    cache = spark.createDataFrame([("equity", "C", 5.0, "JPY", 700.0), ("equity", "Q", 6.0, "JPY", 699.0)], p + ", fetched_at double")
    quotes = spark.createDataFrame([("equity", "C", 8.0, "JPY"), ("equity", "Q", 9.0, None), ("equity", "E", None, "JPY"), ("fund", "F", 99.0, "JPY")], p)
    series = spark.createDataFrame([("fund", "F"), ("fund", "G"), ("equity", "C"), ("equity", "Q"), ("equity", "E"), ("equity", "N"), ("manual", "7")], "source string, ref string")
    spots = fetching.source_spots(series, daily, cache, quotes, 1000)
    got = {(r.source, r.ref): (r.price, r.currency, r.origin) for r in spots.collect()}
    assert got == {("fund", "F"): (2.0, "JPY", "stored"), ("fund", "G"): (None, None, None), ("equity", "C"): (5.0, "JPY", "cache"), ("equity", "Q"): (9.0, "JPY", "quote"), ("equity", "E"): (3.0, "USD", "fallback"), ("equity", "N"): (None, None, None), ("manual", "7"): (40.0, "JPY", "stored")}
    secs = spark.createDataFrame([(1, "JPY", "linked", "fund", "F", False), (2, "JPY", "linked", "equity", "E", None), (3, "JPY", "linked", "equity", "N", False), (4, "JPY", "unlinked", "equity", "C", False), (5, "JPY", "linked", "equity", "C", True), (6, "JPY", "linked", "equity", "", False), (7, "JPY", "manual", "none", None, False), (8, "JPY", "linked", "none", "x", False)], "security_id long, currency string, status string, source string, ref string, inactive boolean")
    manual = spark.createDataFrame([(7, 55.0, True), (1, 1.0, True)], "security_id long, value double, indexed boolean")
    got = {r.security_id: (r.price, r.origin, r.warnings) for r in fetching.security_spots(secs, spots, manual).collect()}
    assert got == {1: (2.0, "stored", []), 2: (3.0, "fallback", ["last close", "currency"]), 3: (None, None, ["no price"]), 7: (55.0, "index", [])}
    metals = spark.createDataFrame([("XAU", "E"), ("XAG", "none")], "ref string, future string")
    parts = spark.createDataFrame([("future", "E", 311.034768, "USD", "quote"), ("fx", "USD", 100.0, "JPY", "quote")], p + ", origin string")
    assert [(r.ref, round(r.price, 9)) for r in fetching.metal_quotes(metals, parts).collect()] == [("XAU", 1000.0)]


def test_appraisals_brought_to_today(spark):
    """Against a plain version: linear index, ratio after the last and before the first appraisal, drift between two."""
    rng = random.Random(8)
    day = lambda: D(2020, 1, 1) + dt.timedelta(rng.randrange(900))
    index = {r: {day(): rng.choice([0.0, *[float(rng.randint(50, 150))] * 5]) for _ in range(rng.choice([1, 3, 8]))} for r in "abc"}
    appraised = {(i, rng.choice("abcd")): {day(): float(rng.randint(100, 999)) for _ in range(rng.randint(1, 4))} for i in range(60)}
    today = D(2021, 3, 10)

    def level(r, d):
        pts = sorted((x, v) for x, v in index.get(r, {}).items() if v > 0)
        before, after = [p for p in pts if p[0] <= d], [p for p in pts if p[0] > d]
        if not before:
            return None
        (d0, v0) = before[-1]
        return v0 if not after else v0 + (after[0][1] - v0) * (d - d0).days / (after[0][0] - d0).days

    def value(r, pts):
        pts, now = sorted(pts.items()), level(r, today)
        before, after = [p for p in pts if p[0] <= today], [p for p in pts if p[0] > today]
        if before and after:
            (d0, v0), (d1, v1), w = before[-1], after[0], (today - before[-1][0]).days / (after[0][0] - before[-1][0]).days
            i0, i1 = level(r, d0), level(r, d1)
            return v0 * now / i0 + (v1 - v0 * i1 / i0) * w if None not in (i0, i1, now) else v0 + (v1 - v0) * w
        d0, v0 = before[-1] if before else after[0]
        return v0 * now / level(r, d0) if now is not None and level(r, d0) is not None else v0

    a = spark.createDataFrame([(i, r, d, v) for (i, r), pts in appraised.items() for d, v in pts.items()], "security_id long, index_ref string, date date, price double")
    x = spark.createDataFrame([(r, d, v) for r, pts in index.items() for d, v in pts.items()], "ref string, date date, level double")
    got = {r.security_id: r.value for r in fetching.extended(a, x, F.lit(today)).collect()}
    assert {i: round(v, 6) for i, v in got.items()} == {i: round(value(r, pts), 6) for (i, r), pts in appraised.items()}


def test_totals(spark):
    rows = spark.createDataFrame([("b", "s", 5), ("b", "s", None), ("b", "t", None), ("c", "u", 3)], "batch string, section string, value long")
    stated = spark.createDataFrame([("b", "s", 5), ("b", "t", 1), ("b", "e", 0), ("c", "u", None), ("c", "z", 2)], "batch string, section string, expected long")
    sections = statements.section_totals(rows, stated)
    assert {(r.batch, r.section): (r.rows, r.computed, r.ok) for r in sections.collect()} == {("b", "s"): (2, 5, True), ("b", "t"): (1, None, False), ("b", "e"): (0, 0, True), ("c", "u"): (1, 3, None), ("c", "z"): (0, 0, False)}
    whole = spark.createDataFrame([("b", 5), ("c", None), ("d", 1)], "batch string, expected long")
    got = {r.batch: (r.computed, r.ok, r.wrong_sections, r.unread) for r in statements.grand_totals(sections, whole, spark.createDataFrame([("b",), ("b",)], "batch string")).collect()}
    assert got == {"b": (5, True, 1, 2), "c": (3, None, 1, 0), "d": (None, False, 0, 0)}


def test_carried_back(spark):
    keys = "account_id long, security_id long, "
    change = [(D(2020, 5, 5), 9.0)]
    found = spark.createDataFrame([(1, 1, "traced", D(2021, 1, 1), 4.0, change), (1, 2, "traced", D(2021, 1, 1), 4.0, []), (1, 3, "closed", None, 4.0, change), (1, 4, "traced", D(2021, 1, 1), 0.0, change), (1, 5, "no_trades", D(2021, 1, 1), None, None), (1, 6, "no_earlier_trades", D(2021, 1, 1), None, None), (1, 7, "lots_differ", None, None, None), (1, 8, "linked", D(2021, 1, 1), 4.0, change), (1, 9, "no_trades", D(2021, 1, 1), None, None), (1, 10, "no_trades", D(2021, 1, 1), None, None)], keys + "status string, before date, opening double, changes array<struct<day:date,quantity:double>>")
    first = D(2021, 1, 1)
    lots = [(1, s, 0, first, 10, 5.0, D(2019, 1, 1)) for s in (1, 2, 4, 8)] + [(1, 5, 0, first, 10, 5.0, D(2019, 1, 1)), (1, 5, 1, first, 30, 9.0, D(2019, 1, 1)), (1, 5, 0, D(2021, 2, 1), 7, 1.0, None), (1, 6, 0, first, 10, None, D(2021, 1, 1)), (1, 9, 0, first, 10, 5.0, None), (1, 9, 1, D(2021, 2, 1), 10, 5.0, None), (1, 10, 0, first, 10, 5.0, None)]
    snaps = spark.createDataFrame(lots, keys + "lot_seq int, as_of_date date, quantity long, avg_cost double, acquired_on date")
    ins = spark.createDataFrame([(s, "cash" if s == 10 else "stock") for s in range(1, 11)], "security_id long, asset_class string")
    basis = spark.createDataFrame([(1, 1, 3.5), (1, 2, 0.0)], keys + "residual_cost double")
    got = {r.security_id: (r.quantity, r.until, r.unit_price, r.acquired_on) for r in statements.carried_back(found, snaps, ins, basis).collect()}
    old = D(2019, 1, 1)
    # 4 holds nothing before, 7 starts lot by lot, 8 was moved here, 9 has lots of two days, 10 isn't traded
    assert got == {1: (4.0, D(2020, 5, 5), 3.5, old), 2: (4.0, first, None, old), 3: (4.0, D(2020, 5, 5), None, None), 5: (40.0, first, 8.0, old), 6: (10.0, first, None, None)}


def test_targets(spark):
    kind = "ref int, section string, name string, code string, institution string, quantity double, avg_cost double, price double, value double, point_type string, expiry string, confidence double"
    found = [(0, "deposit", "saving", None, "bank", None, None, None, 700.0, None, None, 1.0), (1, "stock", "A", "72030", "", 5.0, 2.0, 3.0, 15.0, None, None, 0.2), (2, "stock", "B", "zz", None, 5.0, 2.0, 3.0, 15.0, None, None, 0.9), (3, "pension", "P", None, None, 9.0, 100.0, 3.0, 120.0, None, None, 1.0), (4, "point", "x", None, "shop", 9.0, None, None, 9.0, "", "2030-01", 1.0), (5, "loan", "L", None, "bank", 1.0, 1.0, 1.0, 1.0, None, None, 1.0), (6, "fund", "Fü (1)", "7203", "broker", 5.0, None, 3.0, 15.0, None, None, 1.0), (7, None, "n", None, None, None, None, None, None, None, None, None)]
    got = {r.ref: r for r in statements.targets(spark.createDataFrame(found, kind)).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 6]
    assert (got[0].name, got[0].lot_label, got[0].quantity, got[0].avg_cost, got[0].status) == (statements.CASH_NAME, "saving", 700.0, None, "not required")
    assert (got[1].code, got[1].source_ref, got[1].status, got[1].confidence, got[1].no_account) == ("7203", "7203.T", "linked", 0.2, True)
    assert (got[2].code, got[2].status, got[2].confidence) == (None, "unlinked", 0.4)
    assert (got[3].account, got[3].quantity, got[3].avg_cost, got[3].reported_price, got[3].no_account) == (statements.PENSION_ACCOUNT, 1.0, 100.0, None, False)
    assert (got[4].lot_label, got[4].unit) == ("x|2030-01", "point") and (got[6].code, got[6].divisor, got[6].name_key) == (None, 10_000, "fü")


@pytest.mark.parametrize("name", ["lot_assignment", "carried_back"])
def test_the_ledger_is_joined_once(spark, data, name):
    """What a query goes through several times is written; nothing after that reads the line items again."""
    from folioforge.plans import resolving

    assert not [f for f in resolving.QUERIES[name](spark, data).inputFiles() if "lineitem" in f]
