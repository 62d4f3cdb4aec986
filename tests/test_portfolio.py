"""Every portfolio query against its SQL in DuckDB, and the rules of single operators on small inputs."""

import datetime as dt
import decimal
import difflib
import fractions
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from folioforge.functions import text as fx
from folioforge.operators import allocation, asof, ledger, matching, series, valuation
from folioforge.plans import intake, intake_sql, ledgers, ledgers_sql, oracle, queries, resolving, resolving_sql, wealth, wealth_sql

D = dt.date
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


ALL_QUERIES, ALL_SQL = queries.QUERIES | wealth.QUERIES | ledgers.QUERIES | intake.QUERIES | resolving.QUERIES, oracle.SQL | wealth_sql.SQL | ledgers_sql.SQL | intake_sql.SQL | resolving_sql.SQL


@pytest.mark.parametrize("name", sorted(ALL_SQL))
def test_query_matches_sql(spark, sql, data, name):
    df = ALL_QUERIES[name](spark, data)
    columns = sorted(df.columns)
    found = sql.execute(ALL_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = [tuple(plain(r[i]) for i in at) for r in found.fetchall()]
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def lots(spark, rows):
    return spark.createDataFrame(rows, "account_id long, security_id long, quantity long, cost long, bought long, price long, prev_price long, prev_quantity long")


def test_unknown_is_not_zero(spark):
    got = {r.security_id: r for r in valuation.valued(lots(spark, [(1, 1, 10, 500, 5, 7, 6, None), (1, 2, 10, 500, 0, None, 6, 3), (1, 3, 0, 0, 0, 5, 5, 0), (1, 4, 0, 0, 0, 5, 4, 2)])).collect()}
    assert (got[1].value, got[1].lot_cost, got[1].pl, got[1].day_change) == (70, 1000, -930, 10)
    assert got[2].value is None and got[2].lot_cost is None and got[2].prev_value is None and got[2].day_change is None
    assert 3 not in got and got[4].day_change == -8  # zero before and now is dropped; sold today stays


def test_roll_up_flags_partial_days(spark):
    d = valuation.valued(lots(spark, [(1, 1, 10, 500, 5, 7, 6, None), (1, 2, 10, 500, 5, 7, None, None), (2, 1, 1, 5, 5, None, None, None)]))
    got = {r.account_id: r for r in valuation.rolled_up(d, "account_id").collect()}
    assert got[1].day_change == 10 and got[1].day_change_partial and got[1].weight == 1.0
    assert got[2].value is None and got[2].cost is None and got[2].pl_pct is None
    assert valuation.merged_by_security(d).where("security_id = 2").first().day_change is None


def test_as_of_variants(spark):
    s = spark.createDataFrame([("a", D(2024, 1, 10), 1), ("a", D(2024, 1, 20), 2)], "k string, date date, price int")
    days = spark.createDataFrame([("a", D(2024, 1, i)) for i in (1, 10, 15, 20, 31)] + [("b", D(2024, 1, 1))], "k string, d date")
    run = lambda **o: [r.price for r in asof.as_of(days, s, ["k"], "d", "date", ["price"], **o).orderBy("k", "d").collect()]
    assert run() == [None, 1, 1, 2, 2, None]
    assert run(backfill=True) == [1, 1, 1, 2, 2, None]
    assert run(strict=True) == [None, None, 1, 1, 2, None]
    assert run(strict=True, max_days=7) == [None, None, 1, None, None, None]


def test_ranges(spark):
    r = spark.createDataFrame([(1, D(2024, 1, 1), D(2024, 1, 10)), (1, D(2024, 1, 3), D(2024, 1, 4)), (1, D(2024, 1, 11), D(2024, 1, 12)), (1, D(2024, 1, 20), D(2024, 1, 15)), (1, D(2024, 1, 25), D(2024, 1, 26))], "k int, start_date date, end_date date")
    assert sorted(tuple(x)[1:] for x in series.merged_ranges(r, ["k"]).collect()) == [(D(2024, 1, 1), D(2024, 1, 12)), (D(2024, 1, 25), D(2024, 1, 26))]
    gaps = sorted(tuple(x)[1:] for x in series.missing_ranges(r, ["k"], "2023-12-30", "2024-01-31").collect())
    assert gaps == [(D(2023, 12, 30), D(2023, 12, 31)), (D(2024, 1, 13), D(2024, 1, 24)), (D(2024, 1, 27), D(2024, 1, 31))]


def test_chain_link_hits_anchors(spark):
    index = spark.createDataFrame([("x", D(2024, 1, 1), 100.0), ("x", D(2024, 1, 11), 150.0), ("x", D(2024, 1, 21), 120.0)], "k string, date date, level double")
    daily = series.interpolated(index, ["k"], "date", "level", "2024-01-01", "2024-01-31")
    assert daily.where("day = '2024-01-06'").first().level == 125.0 and daily.where("day = '2024-01-31'").first().level == 120.0
    anchors = spark.createDataFrame([("x", D(2024, 1, 1), 1000), ("x", D(2024, 1, 21), 2000), ("x", D(2024, 1, 25), 2400)], "k string, date date, value int")
    got = {r.day: r.value for r in series.chain_linked(anchors, daily, ["k"]).collect()}
    assert got[D(2024, 1, 1)] == 1000 and got[D(2024, 1, 21)] == 2000 and abs(got[D(2024, 1, 11)] - (1500 + 800 / 2)) < 0.01


def tx(spark, rows):
    return spark.createDataFrame([(1, 1, D(2024, 1, i + 1), k, q, g, 0, i, 1, 1) for i, (k, q, g) in enumerate(rows)], "account_id long, security_id long, trade_date date, tx_type string, quantity long, gross long, fee long, l_orderkey long, l_linenumber long, l_partkey long")


def test_opening_cost_is_solved(spark):
    # an opening lot of 100, 100 more for 2000 each, 50 sold; the statement says 150 at 1500: the opening cost is 1000 each
    t = tx(spark, [("buy", 100, 200_000), ("sell", 50, 120_000)])
    s = spark.createDataFrame([(1, 1, 150, 225_000)], "account_id long, security_id long, quantity long, pool long")
    r = ledger.reconciled(t, s, F.lit(100)).first()
    assert (r.opening_quantity, r.opening_cost, r.coverage) == (100, 100_000.0, "partial")
    assert ledger.realized(t, 100, F.lit(100_000)).first().realized == 120_000 - 50 * 1500


def test_pool_restarts_after_a_sale_to_zero(spark):
    t = tx(spark, [("buy", 10, 100), ("sell", 10, 150), ("buy", 5, 100), ("sell", 1, 30)])
    got = {r.l_orderkey: r.realized for r in ledger.realized(t, 0, F.lit(0)).collect()}
    assert got == {1: 50.0, 3: 10.0}
    negative = tx(spark, [("sell", 10, 100), ("buy", 20, 100), ("sell", 1, 1)])
    assert {r.realized for r in ledger.realized(negative, 0, F.lit(0)).collect()} == {None}


def test_untagged_rest_and_ratio(spark):
    h = spark.createDataFrame([(1, 1000), (2, None), (3, 500)], "security_id long, value long")
    w = spark.createDataFrame([(1, 7, 60), (1, 8, 10), (2, 7, 100)], "security_id long, tag_id long, weight long")
    got = {(r.security_id, r.tag_id): r.part for r in allocation.shares(h, w).collect()}
    assert got == {(1, 7): 600.0, (1, 8): 100.0, (1, 0): 300.0, (2, 7): 0.0, (3, 0): 500.0}
    r = allocation.portfolio_ratio(h, w, [7, 8], F.col("security_id") == 3, F.col("security_id") == 2)
    assert {x.security_id: x.ratio for x in r.collect()} == {1: 0.7, 2: 0.0, 3: 1.0}


def test_code_components(spark):
    pairs = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (9, "z")], "entity long, code string")
    assert {(r.entity, r.component) for r in matching.code_components(pairs).collect()} == {(1, 1), (2, 1), (3, 1), (9, 9)}


def brute_code_components(rows):
    label = {e: e for e, _ in rows if e is not None}
    while True:
        code = {}
        for e, c in rows:
            if e is not None and c is not None:
                code[c] = min(code.get(c, label[e]), label[e])
        lower = {e: min([label[e], *[code[c] for x, c in rows if x == e and c is not None]]) for e in label}
        if lower == label:
            return label
        label = lower


def test_code_components_converge(spark):
    """Chains longer than 64 rounds, null codes and repeated pairs, against brute force."""
    rng = random.Random(3)
    chain = [(i, 1000 + i) for i in range(200)] + [(i + 1, 1000 + i) for i in range(200)]
    mixed = rng.sample(range(300, 500), 200)
    chain += [(mixed[i + k], 2000 + i) for i in range(150) for k in (0, 1)]
    rows = [*chain, *chain[:5], (900, None), (None, 1003), (901, 3000), (902, 3000), (902, None)]
    got = {r.entity: r.component for r in matching.code_components(spark.createDataFrame(rows, "entity long, code long")).collect()}
    assert got == brute_code_components(rows)
    assert {got[i] for i in range(201)} == {0}
    words = spark.createDataFrame([("b", 1), ("c", 1), ("c", 2), ("a", 2), ("d", 3)], "entity string, code long")
    assert {tuple(r) for r in matching.code_components(words).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d")}


def test_code_components_cover_every_row(spark, sql, data):
    got = {r.entity for r in queries.QUERIES["code_components_whole"](spark, data).collect()}
    assert got == {r[0] for r in sql.execute("SELECT DISTINCT l_suppkey FROM lineitem").fetchall()}


def test_text_functions(spark):
    d = spark.createDataFrame([("1,234.50", "2024/3/5"), ("(12.00)", "20240305"), ("▲3", "5.3.2024"), ("-", "2024-13-01"), (None, None)], "a string, d string")
    got = d.select(fx.amount(F.col("a")).alias("a"), fx.any_date(F.col("d"), "dmy").alias("d")).collect()
    assert [x.a and float(x.a) for x in got] == [1234.5, -12.0, -3.0, None, None]
    assert [x.d for x in got] == [D(2024, 3, 5)] * 3 + [None, None]
    assert spark.createDataFrame([("ＡＢ１",)], "s string").select(fx.nfkc("s")).first()[0] == "AB1"


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[0] == "asset_class"
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_query_has_sql_but_the_ones_tested_here():
    assert set(ALL_QUERIES) - set(ALL_SQL) == {"fuzzy_name_score"}


def test_suggested_names_match_brute_force(spark, sql, data):
    names_ = [r[0] for r in sql.execute("SELECT DISTINCT p_name FROM part").fetchall()]

    def score(x, y):
        a, b = (t.lower().replace(" ", "") for t in (x, y))
        s = difflib.SequenceMatcher(None, a, b).ratio()
        return round(max(s, min(len(a), len(b)) / max(len(a), len(b))) if a in b or b in a else s, 4)

    expected = set()
    for x in names_:
        best = sorted((-score(x, y), y) for y in names_ if y != x and score(x, y) >= 0.5)[:5]
        expected |= {(x, y, -s, i + 1) for i, (s, y) in enumerate(best)}
    assert {(r["name"], r["other"], r["score"], r["rank"]) for r in queries.QUERIES["fuzzy_name_score"](spark, data).collect()} == expected


def test_thousands_of_half_sales_match_exact_fractions(spark):
    """A pool that is halved and bought back 3,000 times: no underflow, and the exact value in the end."""
    rows, pool, balance = [], fractions.Fraction(0), 0
    for i in range(6_000):
        buy = i % 2 == 0
        q = 100 if i == 0 else 50
        rows.append((1, 1, D(2000, 1, 1) + dt.timedelta(days=i // 4), "buy" if buy else "sell", q, 7_000 + i if buy else 9_000, 3 if buy else 0, i, 1, 1))
        if buy:
            pool, balance = pool + 7_003 + i, balance + q
        else:
            pool, balance = pool * fractions.Fraction(balance - q, balance), balance - q
    tx = spark.createDataFrame(rows, "account_id long, security_id long, trade_date date, tx_type string, quantity long, gross long, fee long, l_orderkey long, l_linenumber long, l_partkey long")
    got = ledger.pooled(tx, 0, F.lit(0.0)).groupBy().agg(F.max_by(F.struct("pool", "balance"), F.struct("trade_date", "l_orderkey")).alias("x")).first().x
    assert got.balance == balance and math.isclose(got.pool, float(pool), rel_tol=1e-9)


def test_partial_transfers_stay_candidates(spark):
    cols = "ref string, account_id long, security_id long, quantity long, trade_date date"
    out = spark.createDataFrame([("o", 1, 9, 100, D(2020, 3, 10))], cols)
    into = spark.createDataFrame([("early", 2, 9, 100, D(2020, 3, 4)), ("part", 3, 9, 60, D(2020, 3, 11)), ("far", 2, 9, 100, D(2020, 4, 9)), ("late", 2, 9, 100, D(2020, 4, 10)), ("own", 1, 9, 100, D(2020, 3, 10))], cols)
    got = [(r.in_ref, r.gap) for r in matching.transfer_candidates(out, into).orderBy("rank").collect()]
    assert got == [("far", 0), ("early", 0), ("part", 40)]


def test_merged_ranges_are_shuffled_as_one_row_a_key(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), D(1969, 6, 1) + dt.timedelta(s := rng.randrange(500)), D(1969, 6, 1) + dt.timedelta(s + rng.randrange(-2, 9))) for _ in range(150)]
    merged = series.merged_ranges(spark.createDataFrame(rows * 3, "k string, start_date date, end_date date"), ["k"])
    days = {(k, a + dt.timedelta(i)) for k, a, b in rows for i in range((b - a).days + 1)}
    starts = sorted((k, d) for k, d in days if (k, d - dt.timedelta(1)) not in days)
    ends = sorted((k, d) for k, d in days if (k, d + dt.timedelta(1)) not in days)
    assert sorted(map(tuple, merged.collect())) == [(k, a, b) for (k, a), (_, b) in zip(starts, ends, strict=True)]
    assert "Window" not in merged._jdf.queryExecution().executedPlan().toString()  # which sorts a row for each range
