"""What queries share is computed once: joins of the ledger, expressions that many columns use, joins with nothing."""

import datetime as dt

from folioforge.operators import classify, navs, paths
from folioforge.plans import intake, ledgers, queries, resolving
from folioforge.sources import domain as dm

D = dt.date


def _files(d):
    return [f.rsplit("/", 1)[-1] for f in d.inputFiles()]


def test_line_items_are_shuffled_once_for_the_ledger(spark, data):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = dm.ledger(spark, data)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    # the first join of the tree is the one with line items, so its other side is orders with customers
    assert "l_orderkey" in plan.split("SortMergeJoin")[1].split("\n")[0]
    assert plan.count("SortMergeJoin") == 2


def test_months_give_snapshots_and_prices(spark, data):
    tx = dm.ledger(spark, data)
    m = dm.months(tx)
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(dm.month_prices(m)) == rows(dm.prices(tx))


def test_pensions_and_links_read_the_ledger_once(spark, data):
    for name in ("pension_units", "link_suggestions", "nav_movements"):
        assert "lineitem.parquet" not in _files(intake.QUERIES[name](spark, data)), name


def test_days_of_a_series_are_looked_up_once(spark):
    s = spark.createDataFrame([(i, "f", D(2024, 1, 31), 100_000) for i in range(50)], "account_id long, ref string, as_of date, value long")
    p = spark.createDataFrame([("f", D(2024, 1, 30), 10_000)], "ref string, date date, nav long")
    seen = []
    kept, navs.written = navs.written, lambda d, label: seen.append(d.count()) or d
    try:
        assert {r.units for r in navs.derived_units(s, p).collect()} == {100_000.0}
    finally:
        navs.written = kept
    assert seen == [1]


def test_names_and_prices_come_from_stored_rows(spark, data):
    for name in ("current_spots", "name_links", "link_candidates"):
        assert "lineitem.parquet" not in _files(resolving.QUERIES[name](spark, data)), name
    plan = resolving.QUERIES["composable_gaps"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    # the rates alone come from the ledger, and those of two securities
    assert plan.count("l_suppkey") > 0 and "trade-days" in "".join(resolving.QUERIES["composable_gaps"](spark, data).inputFiles())


def test_decisions_of_a_row_are_made_once(spark, data):
    plan = classify.transactions(intake._rows(spark, data))._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 60_000  # 145,439 when each use had the text of all before it


def test_keys_of_equal_rows_meet_as_bytes(spark, data):
    plan = queries.QUERIES["dedup_key"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1 and "unhex(" in plan


def test_moves_read_the_ledger_once(spark, data):
    tx, statements = ledgers._moves(spark, data)
    assert "lineitem.parquet" not in _files(tx) + _files(statements)


def test_paths_without_links_meet_none(spark):
    tx = spark.createDataFrame([(1, 1, D(2024, 1, 5), "a", "buy", 5.0, None)], "account_id long, security_id long, trade_date date, ref string, kind string, quantity double, split_ratio double")
    s = spark.createDataFrame([(1, 1, 0, D(2024, 2, 1), 8.0)], "account_id long, security_id long, lot_seq int, as_of_date date, quantity double")
    p = paths.quantity_paths(tx, s, ["trade_date", "ref"])
    assert [(r.status, r.opening, len(r.changes)) for r in p.collect()] == [("traced", 3.0, 1)]
    plan = p._jdf.queryExecution().optimizedPlan().toString()
    assert "absorbed" not in plan and "from_account" not in plan
