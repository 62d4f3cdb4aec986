"""Daily worth, price chains, coins and rules on small inputs."""

import datetime as dt

from pyspark.sql import functions as F

from folioforge.operators import allocation, history
from folioforge.plans import ledgers

D = dt.date
LOTS = "account_id long, security_id long, lot_seq int, as_of_date date, quantity double, avg_cost double, reported double"
INSTRUMENTS = "security_id long, asset_class string, currency string, divisor int, linked boolean"
PRICES = "security_id long, date date, price double, price_currency string"


def test_worth_by_route(spark):
    day = D(2024, 1, 2)
    lots = spark.createDataFrame([
        (1, 1, 0, day, 10.0, 5.0, 7.0), (1, 2, 0, day, 10.0, None, None), (1, 3, 0, day, 1.0, 900.0, 800.0), (1, 4, 0, day, 50.0, None, None), (1, 5, 0, day, 3.0, 2.0, 44.0), (1, 6, 0, day, 4.0, None, 12.0),
    ], LOTS)
    instruments = spark.createDataFrame([(1, "stock", "USD", 1, False), (2, "cash", "USD", 1, False), (3, "pension", "JPY", 10_000, True), (4, "point", "JPY", 1, False), (5, "stock", "EUR", 1, False), (6, "cash", "EUR", 1, False)], INSTRUMENTS)
    prices = spark.createDataFrame([(1, D(2024, 1, 1), 6.0, "USD"), (1, D(2024, 1, 3), 8.0, "USD"), (3, day, 100.0, "JPY"), (5, day, 9.0, "EUR")], PRICES)
    rates = spark.createDataFrame([("USD", D(2024, 1, 3), 150.0)], "currency string, date date, rate double")
    got = history.worth(history.lot_days(lots, "2024-01-01", "2024-01-03"), instruments, prices, rates, "2024-01-01", "2024-01-03").collect()
    at = {(r.security_id, r.day.day): (r.value, r.cost) for r in got}
    assert at[1, 1] == (10 * 6 * 150, 10 * 5 * 150) and at[1, 3] == (10 * 8 * 150, 7500)  # before the first rate the first, lots too
    assert at[2, 2] == (1500, None) and at[3, 2] == (800, 900) and at[4, 2] == (50, None)
    assert at[5, 2] == (44, None) and at[6, 2] == (12, None)  # no rate: as reported, and no cost
    assert {r.backfilled for r in got if r.day.day == 1} == {True} and {r.backfilled for r in got if r.day.day > 1} == {False}


def test_paths_stand_for_lots_before_their_statement(spark):
    lots = spark.createDataFrame([(1, 1, 0, D(2024, 1, 3), 6.0, 10.0, 60.0), (1, 1, 1, D(2024, 1, 3), 4.0, 20.0, 40.0), (1, 2, 0, D(2024, 1, 3), 5.0, None, None)], LOTS)
    paths = spark.createDataFrame([(1, 1, "traced", D(2024, 1, 3), 2.0, [(D(2024, 1, 2), 5.0)]), (1, 2, "inconsistent", D(2024, 1, 3), None, None), (1, 3, "closed", None, 0.0, [(D(2024, 1, 2), 7.0), (D(2024, 1, 3), 0.0)])], "account_id long, security_id long, status string, before date, opening double, changes array<struct<day: date, quantity: double>>")
    rows = lambda only: {(r.security_id, r.day.day, r.quantity, r.avg_cost, r.reported, r.backfilled) for r in history.lot_days(lots, "2024-01-01", "2024-01-03", paths, only).collect()}
    shared = {(1, 1, 2.0, 14.0, 20.0, True), (1, 2, 5.0, 14.0, 50.0, False), (1, 3, 6.0, 10.0, 60.0, False), (1, 3, 4.0, 20.0, 40.0, False), (2, 1, 5.0, None, None, True), (2, 2, 5.0, None, None, True), (2, 3, 5.0, None, None, False)}
    assert rows(False) == shared and rows(True) == shared | {(3, 2, 7.0, None, None, False)}


def test_coins(spark):
    assets = spark.createDataFrame([("A", "2", "5", "10", True, "8", "d"), ("B", "x", "5", "10", True, None, "d"), ("", "1", "1", "1", True, None, "d"), ("C", "1", None, None, True, "1", "d"), ("D", "1", "1", "1", False, "1", "d"), ("E", "1", "1", "3", True, "bad", "d")], "asset string, balance string, price string, value string, has_price boolean, prev_value string, prev_date string")
    rows = history.coin_rows(assets)
    assert {(r.symbol, float(r.value), r.day_change and float(r.day_change), r.day_change_pct, r.as_of) for r in rows.collect()} == {("A", 10.0, 2.0, 25.0, "d"), ("E", 3.0, None, None, None)}
    total = history.coin_totals(rows).first()
    assert (float(total.value), float(total.prev_value), float(total.day_change), total.partial, total.coins) == (13.0, 8.0, 2.0, True, 2)
    points = spark.createDataFrame([("A", "2024-01-01", "1"), ("A", "2024-01-03", "x"), ("A", "2024-01-10", "9"), ("B", "2023-12-01", "2")], "symbol string, t string, value string")
    assert {(r.symbol, float(r.prev_value)) for r in history.coin_previous(points, "2024-01-05").collect()} == {("A", 1.0)}
    classes = spark.createDataFrame([("stock", 87.0, 80.0, 7.0, False, 3, True), ("point", 10.0, None, None, False, 1, False)], "asset_class string, value double, prev_value double, day_change double, partial boolean, holdings long, in_total boolean")
    got = {r.asset_class: r for r in history.with_coins(classes, history.coin_totals(rows).select(*[F.col(c).cast("double") if c not in ("partial", "coins") else F.col(c) for c in ("value", "prev_value", "day_change", "partial", "coins")]), True).collect()}
    assert (got["crypto"].weight, got["stock"].weight, got["point"].weight, got["crypto"].partial) == (13.0, 87.0, None, True)


def test_rules_by_code_keyword_and_class(spark):
    rules = [allocation.Rule("gold", (("g", 100),), ("ゴールド", "gold"), ("goldman",)), allocation.Rule("jp", (("j", 60), ("none", 40)), ("topix",), classes=("fund",)), allocation.Rule("guess", (("j", 100),), classes=("stock",), fallback=True)]
    rows = [(1, "SSゴールド", None, "fund"), (2, "Goldman Sachs", None, "stock"), (3, "TOPIX連動型", None, "stock"), (4, "topix", None, "fund"), (5, "x", "1475 ", "cash"), (6, "x", "999", "cash"), (7, None, None, "stock")]
    d = spark.createDataFrame(rows, "security_id long, name string, code string, asset_class string")
    m = allocation.matched_rules(d, rules, {"1475": "gold", "999": "unknown"})
    got = {r.security_id: (r.rule, r.matched_by, r.matched_value, r.doubtful) for r in m.collect()}
    assert got == {1: ("gold", "keyword", "ゴールド", False), 2: ("guess", "class", "stock", False), 3: ("guess", "class", "stock", True), 4: ("jp", "keyword", "topix", False), 5: ("gold", "code", "1475", False), 6: (None, None, None, False), 7: ("guess", "class", "stock", False)}
    tags = spark.createDataFrame([(1, "g"), (2, "j")], "tag_id long, name string")
    current = spark.createDataFrame([(1, 1, 100.0), (2, 1, 100.0)], "security_id long, tag_id long, weight double")
    s = {r.security_id: (r.status, [tuple(x) for x in r.suggested or []], r.missing) for r in allocation.suggestions(m, rules, tags, current).collect()}
    assert s[1] == ("unchanged", [(1, 100.0)], []) and s[2] == ("change", [(2, 100.0)], []) and s[3] == ("new", [(2, 100.0)], []) and s[4] == ("missing-tag", [(2, 60.0)], ["none"]) and s[6][0] == "no-rule"
    symbols = spark.createDataFrame([("usdt ",), ("BTC",), (" ",), (None,)], "s string")
    assert [r[0] for r in symbols.select(allocation.symbol_rule(F.col("s"), ("USDT",), "stable", "coin")).collect()] == ["stable", "coin", None, None]


def test_price_chain_and_fill(spark):
    row = "security_id long, date date, price double, currency string"
    linked = spark.createDataFrame([(1, D(2024, 1, 1), 10.0, "USD"), (1, D(2024, 1, 2), 11.0, "USD")], row)
    manual = spark.createDataFrame([(1, D(2024, 1, 2), 99.0, "JPY"), (2, D(2024, 1, 2), 50.0, "JPY")], row)
    derived = spark.createDataFrame([(1, D(2024, 1, 5), 1.0, "JPY"), (2, D(2024, 1, 2), 50.0, "EUR"), (2, D(2024, 1, 3), 51.0, "EUR")], row)
    reported = spark.createDataFrame([(2, D(2024, 1, 1), 7.0, "EUR"), (3, D(2024, 1, 1), 8.0, "EUR")], row)
    chain = history.price_chain(linked, manual, derived, reported)
    assert {tuple(r) for r in chain.collect()} == {(1, D(2024, 1, 1), 10.0, "USD", "linked"), (1, D(2024, 1, 2), 99.0, "USD", "manual"), (2, D(2024, 1, 2), 50.0, "EUR", "derived"), (2, D(2024, 1, 3), 51.0, "EUR", "derived"), (3, D(2024, 1, 1), 8.0, "JPY", "reported")}
    trades = spark.createDataFrame([("a", 1, "USD", D(2024, 1, 9)), ("b", 1, "USD", D(2024, 1, 10)), ("c", 1, "JPY", D(2024, 1, 2)), ("d", 2, "EUR", D(2024, 1, 1))], "ref string, security_id long, currency string, trade_date date")
    assert {(r.ref, r.price, r.priced_on) for r in history.trade_prices(trades, chain).collect()} == {("a", 99.0, D(2024, 1, 2)), ("b", None, None), ("c", None, None), ("d", None, None)}


def test_histories_make_days_after_their_joins(spark):
    """Prices, instruments and paths meet spans, so days are shuffled once for prices and never for rates or paths."""
    lots = spark.createDataFrame([(1, 1, 0, dt.date(2024, 1, 1), 2.0, 3.0, None)], "account_id long, security_id long, lot_seq int, as_of_date date, quantity double, avg_cost double, reported double")
    paths = spark.createDataFrame([(1, 1, "traced", dt.date(2024, 1, 1), 1.0, [])], "account_id long, security_id long, status string, before date, opening double, changes array<struct<day:date,quantity:double>>")
    days = history.lot_days(lots, "2023-12-30", "2024-01-03", paths)
    assert [(r.day.day, r.quantity) for r in days.orderBy("day").collect()] == [(30, 1.0), (31, 1.0), (1, 2.0), (2, 2.0), (3, 2.0)]
    instruments = spark.createDataFrame([(1, "stock", "USD", 1, False)], "security_id long, asset_class string, currency string, divisor int, linked boolean")
    prices = spark.createDataFrame([(1, dt.date(2023, 12, 31), 5.0, "USD"), (1, dt.date(2024, 1, 2), 7.0, "USD")], "security_id long, date date, price double, price_currency string")
    rates = spark.createDataFrame([("USD", dt.date(2024, 1, 1), 10.0)], "currency string, date date, rate double")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = history.worth(days, instruments, prices, rates, "2023-12-30", "2024-01-03")
        assert [r.value for r in d.orderBy("day").collect()] == [50.0, 50.0, 100.0, 140.0, 140.0]
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        # nothing but prices and rates stands above the days
        assert plan[: plan.index("Generate explode")].count("Join ") == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_price_chains_join_the_ledger_once(spark, data):
    assert not [f for f in ledgers.QUERIES["price_chain"](spark, data).inputFiles() if "lineitem" in f]
    # the trades themselves are read, and nothing of them a second time for the series
    plan = ledgers.QUERIES["trade_price_fill"](spark, data)._jdf.queryExecution().analyzed().toString()
    assert plan.count("l_linenumber#") and plan.count("sum(gross") == 0


def test_price_chain_covers_every_security_and_day(spark, monkeypatch):
    # 1 is linked, 22 too with manual rows; 3 and 32 are only appraised, 4 and 5 only reported
    ends = [D(1995, 3, 31), D(1997, 6, 30), D(1998, 5, 31), D(1999, 9, 30), D(2000, 1, 31)]
    rows = [(s, d, 100 * s + i) for s in (1, 3, 4, 5, 22, 32) for i, d in enumerate(ends)] + [(1, None, 9)]
    monkeypatch.setattr(ledgers.dm, "ledger", lambda spark, sf: None)
    monkeypatch.setattr(ledgers.dm, "prices", lambda tx: spark.createDataFrame(rows, "security_id long, date date, price long"))
    want = {(1, None, 9.0, "EUR", "linked")} | {(1, d, 100.0 + i, "EUR", "linked") for i, d in enumerate(ends)} | {(s, d, 2.0 * (100 * s + i), "JPY", "reported") for s in (4, 5) for i, d in enumerate(ends)}
    want |= {(22, d, 2200.0 + i + 7 * (d.month % 3 == 0), "JPY", "manual" if d.month % 3 == 0 else "linked") for i, d in enumerate(ends)}
    for s in (3, 32):
        day = ends[0]
        while day <= ends[-1]:
            last = max(i for i, d in enumerate(ends) if d <= day and d.month % 3 == 0)
            want.add((s, day, 100.0 * s + last + 7, "JPY", "derived"))
            day += dt.timedelta(days=1)
    got = [tuple(r) for r in ledgers.QUERIES["price_chain"](spark, "").collect()]
    assert len(got) == len(set(got)) and set(got) == want
