"""Watched folders, accept gates, NAV checks, units and merges against plain versions on small inputs."""

import datetime as dt
import random
from fractions import Fraction as Q

from pyspark.sql import functions as F

from folioforge.operators import merging, navs
from folioforge.plans import wealth
from folioforge.streaming import watch

D = dt.date
DAY = D(2024, 1, 1)


def plain_scans(scans):
    """Ready files of a list of folder states {name: form}, as a watcher would find them."""
    waits, done, out = {}, {}, []
    for i, files in enumerate(scans):
        for name, form in files.items():
            if done.get(name) == form:
                continue
            if waits.get(name) != form:
                waits[name] = form
                continue
            waits.pop(name)
            done[name] = form
            out.append((name, i, *form))
        waits, done = ({k: v for k, v in x.items() if k in files} for x in (waits, done))
    return sorted(out)


def test_ready_files_equal_a_watcher(spark, tmp_path):
    rng = random.Random(2)
    scans = [{f"f{k}": (rng.choice([1, 1, 1, 2]), rng.choice([5, 5, 6])) for k in range(25) if rng.random() < 0.85} for _ in range(40)]
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), n, *form) for i, files in enumerate(scans) for n, form in files.items()]
    for lo in range(0, 40, 9):  # several batches, with a scan read twice
        spark.createDataFrame([r for r in rows if lo - 1 <= r[0] < lo + 9] + [(lo, dt.datetime(2024, 1, 1), None, 1, 1)], watch.LISTING).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(watch.LISTING).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = watch.drained_ready(stream, str(tmp_path), 60).collect()
    assert sorted((r["name"], r["scan"], r["size"], r["mtime"]) for r in got) == plain_scans(scans)


def test_ready_files_share_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(watch, "BUCKETS", 3)  # each call sees many files: some new, some expired, some unseen in its batch
    rng = random.Random(4)
    scans = [{f"f{k}": (rng.choice([1, 1, 2]), 5) for k in range(60) if (k + i // 6) % 3 and rng.random() < 0.9} for i in range(36)]
    for lo in range(0, 36, 6):
        rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), n, *form) for i in range(lo, lo + 6) for n, form in scans[i].items()]
        spark.createDataFrame(rows, watch.LISTING).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(watch.LISTING).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert watch.ready_files(stream, 3600)._jdf.queryExecution().analyzed().toString().count("bucket")  # a call is for a bucket, not for a file
    got = watch.drained_ready(stream, str(tmp_path), 3600).collect()
    assert sorted((r["name"], r["scan"], r["size"], r["mtime"]) for r in got) == plain_scans(scans)


def test_accept_gate(spark):
    previews = spark.createDataFrame([("ok", True), ("sum", False), ("part", None), ("none", True), ("bare", None)], "batch string, total_ok boolean")
    sections = spark.createDataFrame([("ok", "a", True, True), ("ok", "b", False, None), ("sum", "a", True, None), ("part", "a", True, False), ("part", "b", False, False), ("none", "a", False, True)], "batch string, section string, included boolean, sums_ok boolean")
    rows = spark.createDataFrame([("ok", "1", "a", "new", False), ("ok", "2", "a", "missing", None), ("ok", "3", "a", "missing", False), ("ok", "4", "b", "missing", True), ("ok", "5", "a", "new", None)], "batch string, key string, section string, status string, included boolean")
    got = {r.batch: r for r in watch.accepted(previews, sections, rows).collect()}
    assert (got["ok"].accepted, got["ok"].sections, got["ok"].excluded, got["ok"].zeroed) == (True, ["a"], 1, 1)
    assert [got[k].reasons for k in ("sum", "part", "none", "bare")] == [["total"], ["sections a,b"], ["nothing to include"], ["nothing to include"]]


def series(rng, refs, days):
    return [(f"r{k}", DAY + dt.timedelta(d), rng.randint(900_000, 1_100_000) if rng.random() < 0.97 else 0) for k in range(refs) for d in range(days) if rng.random() < 0.6]


def test_nav_verification(spark):
    rng = random.Random(3)
    prices = series(rng, 3, 90)
    reports = []
    for i in range(120):
        ref = f"r{rng.randrange(4)}"
        mine = [p for r, _, p in prices if r == ref]
        reports.append((str(i), ref, DAY + dt.timedelta(rng.randint(-5, 100)), rng.choice([*mine[:40], 1, None]) if mine else 5))
    got = {(r.id, r.ref): r for r in navs.verified(spark.createDataFrame(reports, "id string, ref string, as_of date, reported long"), spark.createDataFrame(prices, "ref string, date date, nav long")).collect()}
    assert len(got) == len(reports)
    for i, ref, as_of, reported in reports:
        window = {d: p for r, d, p in prices if r == ref and as_of - dt.timedelta(7) <= d <= as_of}
        hits = [d for d, p in window.items() if p == reported]
        r = got[i, ref]
        assert (r.matched, r.matched_on, r.latest) == (bool(hits), max(hits, default=None), window[max(window)] if window else None)


def test_movements(spark):
    rng = random.Random(4)
    prices = [(r, d, float(p)) for r, d, p in series(rng, 3, 200) if p]
    by = {r: {d: p for x, d, p in prices if x == r} for r in ("r0", "r1", "r2")}
    rows = []
    for s in range(12):
        for account in range(2):
            units, cost, ref = 5.0, 100_000.0, by[f"r{s % 3}"]
            for k in range(9):
                day = DAY + dt.timedelta(20 * k + account)
                past = [d for d in ref if d <= day and d >= day - dt.timedelta(10)]
                value = units * ref[max(past)] if past else None
                rows.append((account, s, 0, day, rng.choice([1.0, 1.0, 0.0]), None if value is None else value + (80_000 if s % 4 == 3 else 0) * (k % 2), rng.choice([cost, cost, cost, None])))
                if past:
                    units, cost = units + 7_000 / ref[max(past)], cost + 7_000
    st = spark.createDataFrame(rows, "account_id long, security_id long, lot_seq int, as_of_date date, quantity double, value double, cost double")
    pairs = navs.value_pairs(st)
    candidates = spark.createDataFrame([(s, f"r{r}") for s in range(12) for r in range(4)], "security_id long, ref string")
    got = {(r.security_id, r.ref): r for r in navs.movement_checked(pairs, candidates, spark.createDataFrame(prices, "ref string, date date, nav double")).collect()}
    for s in range(12):
        found = []
        for account in range(2):
            mine = sorted(r for r in rows if r[:2] == (account, s) and r[4] and r[5] is not None)
            found += [(b[3], account, a[3], a[5], a[6], b[5], b[6]) for a, b in zip(mine, mine[1:], strict=False) if a[6] is not None and b[6] is not None]
        for ref in ("r0", "r1", "r2", "r3"):
            checked = passed = 0
            for t2, _, t1, v1, c1, v2, c2 in sorted(found)[-6:]:
                window = lambda t, ref=ref: [p for d, p in by.get(ref, {}).items() if t - dt.timedelta(14) <= d <= t]
                if window(t1) and window(t2):
                    checked += 1
                    passed += min(abs(v1 * b / a + c2 - c1 - v2) for a in window(t1) for b in window(t2)) <= max(v2 * 0.005, 10)
            r = got.get((s, ref))
            assert (r.checked, r.explained) == (checked, passed == checked if checked else None) if found else r is None
    assert {r.explained for r in got.values()} == {True, False, None}


def test_units(spark):
    rng = random.Random(5)
    prices = series(rng, 3, 120)
    rows = []
    for i in range(200):
        ref, as_of = f"r{rng.randrange(4)}", DAY + dt.timedelta(rng.randint(-10, 400))
        mine = [p for r, d, p in prices if r == ref and p and d <= as_of]
        value = rng.choice([None, 0, -5, rng.randint(1, 10**9), rng.randint(1, 50) * mine[-rng.randint(1, min(8, len(mine)))] // 100 * 100 if mine else 7])
        rows.append((str(i), ref, as_of, value))
    got = {r.id: r for r in navs.derived_units(spark.createDataFrame(rows, "id string, ref string, as_of date, value long"), spark.createDataFrame(prices, "ref string, date date, nav long")).collect()}
    assert len(got) == len(rows)
    for i, ref, as_of, value in rows:
        mine = sorted((d, p) for r, d, p in prices if r == ref and d <= as_of)
        units = exact = None
        if value and value > 0 and mine:
            window = [p for d, p in mine if d >= mine[-1][0] - dt.timedelta(14) and p > 0][::-1]
            for p in window:
                n = int(Q(value * 10_000, p) + Q(1, 2))
                if n >= 1 and abs(Q(n * p, 10_000) - value) < 100:
                    units, exact = float(n), True
                    break
            else:
                if window:
                    units, exact = float(round(Q(value * 10_000, window[0]), 4)), False
        assert (got[i].units, got[i].exact) == (units, exact), (i, got[i], units, exact)


def test_merges_keep_every_lot_apart(spark):
    rng = random.Random(6)
    securities = spark.createDataFrame([(i, "fund", "JPY" if i != 9 else "USD", None, 1, f"n{i}", f"c{i}" if i % 3 else None, "unlinked" if i < 3 else "linked", f"r{i}") for i in range(12)], "security_id long, asset_class string, currency string, unit string, divisor int, name_key string, code string, price_status string, price_ref string")
    pairs = spark.createDataFrame([(5, 1, 2), (6, 1, 1), (7, 2, 1), (8, 8, 1), (9, 1, 3), (10, 99, 1), (11, 1, 4), (11, 2, 9)], "source long, target long, rank int")
    mapping, conflicts = merging.mergeable(securities, pairs)
    assert {(r.source, r.target) for r in mapping.collect()} == {(5, 1), (6, 1), (7, 2), (11, 1)}
    assert {(r.source, r.conflict) for r in conflicts.collect()} == {(8, "itself"), (9, "currency"), (10, "unknown")}
    rows = sorted({(a, s, lot, DAY + dt.timedelta(d)) for a in range(4) for s in (1, 2, 5, 6, 7, 11) if rng.random() < 0.8 for lot in rng.sample(range(6), 3) for d in range(3)})
    snaps = spark.createDataFrame([(*r, float(i)) for i, r in enumerate(rows)], "account_id long, security_id long, lot_seq int, as_of_date date, quantity double")
    # one source after the other, as a person would merge them
    plain = {r: r for r in rows}
    for source, target in ((6, 1), (5, 1), (11, 1), (7, 2)):
        for a in range(4):
            mine = {v[2] for v in plain.values() if v[0] == a and v[1] == source}
            there = {v[2] for v in plain.values() if v[0] == a and v[1] == target}
            new = dict(zip(sorted(mine), range(max(there | mine, default=0) + 1, 99), strict=False)) if there else {x: x for x in mine}
            plain |= {k: (a, target, new[v[2]], v[3]) for k, v in plain.items() if v[:2] == (a, source)}
    got = {(r.account_id, r.security_id, r.lot_seq, r.as_of_date): r.quantity for r in merging.merged_snapshots(snaps, mapping).collect()}
    assert got == {plain[r]: float(i) for i, r in enumerate(rows)}
    tags = spark.createDataFrame([(1, "a", 10), (5, "a", 20), (5, "b", 30), (6, "b", 40), (7, "a", 50), (3, "a", 60)], "security_id long, tag string, weight int")
    assert {tuple(r) for r in merging.retargeted_once(tags, mapping, ["security_id", "tag"]).collect()} == {(1, "a", 10), (1, "b", 40), (2, "a", 50), (3, "a", 60)}
    s = {r.security_id: r for r in merging.merged_securities(securities, mapping).collect()}
    assert set(s) == {0, 1, 2, 3, 4, 8, 9, 10} and (s[1].price_status, s[1].price_ref, s[1].code) == ("linked", "r6", "c1")
    aliases = spark.createDataFrame([("x", 5), ("y", 3), ("n6", 3)], "alias string, security_id long")
    assert {tuple(r) for r in merging.merged_aliases(aliases, securities, mapping).where(F.col("alias").isin("x", "y", "n6", "n1", "n5")).collect()} == {("x", 1), ("y", 3), ("n6", 1), ("n1", 1), ("n5", 1)}
    assert merging.merged_snapshots(snaps, mapping.where("false")).exceptAll(snaps).isEmpty()


def test_link_decisions(spark):
    rows = [
        (1, "a", 0.9, True, None, True), (1, "b", 0.95, False, None, True), (2, "a", 0.1, True, None, True), (3, "a", 0.5, True, None, True), (3, "b", 0.4, True, True, True), (4, "a", 0.1, None, True, False), (4, "b", 0.3, False, None, True),
        (5, "a", 0.1, False, False, True), (6, "d", 0.9, None, None, True), (6, "a", 0.9, None, None, True), (6, "b", 0.8, None, None, True), (6, "c", 0.7, True, None, True),
    ]
    got = {r.security_id: (r.status, r.reason, r.best_ref, r.shown) for r in navs.link_decisions(spark.createDataFrame(rows, "security_id long, ref string, score double, matched boolean, explained boolean, reachable boolean")).collect()}
    assert got == {
        1: ("auto", "price", "a", ["a", "b"]), 2: ("none", "no price", None, ["a"]), 3: ("candidates", "several prices", None, ["b", "a"]), 4: ("candidates", "prices unread", None, ["a"]), 5: ("none", "no price", None, ["a"]),
        6: ("candidates", "no price", None, ["a", "d", "b"]),
    }


def test_divisors_of_a_hundred_and_a_thousand_are_found(spark, monkeypatch):
    rows = spark.createDataFrame([(d, 3, 3 * 1_234, d) for d in (1, 100, 1_000, 10_000)] + [(7, 3, 3 * 1_234, 50)], "security_id long, quantity long, gross long, divisor int")
    monkeypatch.setattr(wealth, "_rich", lambda spark, sf: rows)
    got = {r.security_id: (r.divisor, r.hits, r.n) for r in wealth.divisor_inference(spark, "").collect()}
    assert got == {1: (1, 1, 1), 100: (100, 1, 1), 1_000: (1_000, 1, 1), 10_000: (10_000, 1, 1), 7: (1, 0, 1)}


def test_sums_in_responses_do_not_depend_on_the_order(spark, monkeypatch):
    for values in ([1e16, 1.0, 1.0, 1.0], [1.0, 1.0, 1.0, 1e16]):
        rows = spark.createDataFrame([("stock", (v,), 1.0, 1, 1, "JPY", 1.0) for v in values], "asset_class string, now struct<value: double>, avg_cost double, quantity long, divisor int, currency string, rate double").coalesce(1)
        monkeypatch.setattr(wealth, "_routed", lambda spark, sf, rows=rows: rows)
        assert [r.value for r in wealth.summary_json(spark, "").collect()] == ["10000000000000004.00"]
