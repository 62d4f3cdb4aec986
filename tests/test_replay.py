"""Replay, paths and transfers against plain versions in exact fractions."""

import datetime as dt
import random
from fractions import Fraction as Q

import pytest
from pyspark.sql import functions as F

from folioforge.operators import paths, replay
from folioforge.sources.domain import half_up

TX = "account_id long, security_id long, trade_date date, id long, kind string, quantity double, unit_price double, gross_amount double, net_amount double, fee double, tax double, split_ratio double, divisor long, currency string"
ANCHOR = "account_id long, security_id long, as_of_date date, quantity double, avg_cost double, currency string, lots int, acquired_on date"
DAY = dt.date(2020, 1, 1)


def plain(txs, anchor):
    """(coverage, q0, c0, residual, avg, realized, stops) by the rules, one transaction after the other."""
    held, avg, div = Q(anchor[0]), anchor[1] if anchor[1] is None else Q(anchor[1]), txs[0][12]
    amount = lambda t: Q(abs(t[7])) if t[7] else (Q(abs(t[8])) - Q(t[9]) - Q(t[10]) if t[4] in ("buy", "reinvest") else Q(abs(t[8])) + Q(t[9]) + Q(t[10])) if t[8] else Q(abs(t[5])) * Q(t[6]) if t[5] is not None and t[6] is not None else Q(0)
    value = lambda t: amount(t) / div if not t[7] and not t[8] and t[6] is not None else amount(t)
    qty = lambda t: Q(abs(t[5] or 0))
    alpha, beta = Q(1), Q(0)
    for t in txs:
        if t[4] in replay.ACQUIRES:
            beta += qty(t)
        elif t[4] in ("sell", "transfer_out"):
            beta -= qty(t)
        elif t[4] == "split" and t[11]:
            alpha, beta = alpha * Q(t[11]), beta * Q(t[11])
        elif t[4] == "split" and t[5] is not None:
            beta += Q(t[5])
    q0 = (held - beta) / alpha
    if q0 < 0:
        return ("unreconciled", q0, None, None, None, None, None)
    q, a, b = q0, Q(0), q0 / div
    for t in txs:
        if t[4] in replay.ACQUIRES:
            a, q = a + value(t) + Q(t[9]), q + qty(t)
        elif t[4] in ("sell", "transfer_out"):
            if q > 0:
                a, b = a * (q - qty(t)) / q, b * (q - qty(t)) / q
            q -= qty(t)
        elif t[4] == "split":
            q = q * Q(t[11]) if t[11] else q + Q(t[5] or 0)
        elif t[4] == "return_of_capital":
            a -= Q(abs(t[8] or 0))
    c0 = None
    coverage = "full" if b == 0 else "partial_uncosted" if avg is None else "partial"
    if coverage == "partial":
        c0 = (held * avg / div - a) / b
        if c0 < 0:
            return ("unreconciled", q0, None, None, None, None, None)
    q, pool, rest, realized, sales, stops = q0, q0 * (c0 or 0) / div, q0, Q(0), 0, 0
    for t in txs:
        if t[4] in replay.ACQUIRES:
            q, pool = q + qty(t), pool + value(t) + Q(t[9])
        elif t[4] in ("sell", "transfer_out") and q > 0:
            share = qty(t) / q
            if t[4] == "sell":
                sales, realized = sales + 1, realized + value(t) - Q(t[9]) - pool * share
            q, pool, rest = q - qty(t), pool * (1 - share), rest * (1 - share)
        elif t[4] == "split":
            if t[11]:
                q, rest = q * Q(t[11]), rest * Q(t[11])
            elif t[5] is not None and q:
                q, rest = q + Q(t[5]), rest * (q + Q(t[5])) / q
        elif t[4] == "return_of_capital":
            pool -= Q(abs(t[8] or 0))
            if pool < 0:
                pool, stops = Q(0), stops + 1
    average = pool * div / held if coverage == "full" and held > 0 else avg if coverage == "partial" else None
    return (coverage, q0, c0, max(rest, 0), average, realized if sales else None, stops)


def ledger(rng, account, rows, sell, days):
    """Trades of every type with amounts that are partly missing; sell: how many of them are sales."""
    out, div, balance = [], rng.choice([1, 10_000]), 0
    for i in range(rows):
        kind = rng.choices(["buy", "reinvest", "transfer_in", "sell", "transfer_out", "split", "return_of_capital", "dividend", "other"], [6, 1, 1, sell, 1, 0.05, 1, 1, 1])[0]
        quantity = float(rng.randint(1, 40)) if rng.random() < 0.97 else None
        ratio = rng.choice([None, 2.0, 0.5, 4.0]) if kind == "split" else None
        price = rng.choice([None, float(rng.randint(1, 5_000))])
        gross = rng.choice([None, 0.0, float(rng.randint(1, 90_000))])
        net = float(rng.randint(1, 900)) if kind in ("return_of_capital", "dividend") else rng.choice([None, 0.0, float(rng.randint(1_000, 90_000))])
        if kind == "sell" and rng.random() < 0.3 and balance > 0:
            quantity = float(balance)  # sells out, if nothing was there before
        balance += (quantity or 0) * (1 if kind in replay.ACQUIRES else -1 if kind in ("sell", "transfer_out") else 0)
        out.append((account, 1, DAY + dt.timedelta(i * days // rows), i, kind, quantity, price, gross, net, float(rng.randint(0, 9)), float(rng.randint(0, 9)), ratio, div, "JPY"))
    return sorted(out, key=lambda t: (t[2], t[3]))


def close(x, y):
    return x is None and y is None or x is not None and y is not None and abs(x - float(y)) <= 1e-6 * max(1, abs(float(y)))


@pytest.mark.parametrize(("piece", "run"), [(4_096, 65_536), (3, 20)])
def test_replay_equals_exact_fractions(spark, monkeypatch, piece, run):
    monkeypatch.setattr(replay, "PIECE", piece)
    monkeypatch.setattr(replay, "RUN", run)
    rng = random.Random(piece)
    groups = {a: ledger(rng, a, rng.choice([1, 2, 5, 30, 120]), rng.choice([1, 4, 9]), rng.choice([1, 5, 200])) for a in range(150)}
    groups[500] = ledger(rng, 500, 4_000, 4, 30)
    anchors, expected = {}, {}
    for a, txs in groups.items():
        net = sum((t[5] or 0) * (1 if t[4] in replay.ACQUIRES else -1 if t[4] in ("sell", "transfer_out") else 0) for t in txs if t[4] != "split")
        held = rng.choice([max(net, 0), max(net, 0) + 100, 5_000, 50_000])
        anchors[a] = (float(held), rng.choice([None, float(rng.randint(1, 9_000)), 4e6]))
    closed = {a for a in groups if a % 10 == 3}
    for a, txs in groups.items():
        expected[a] = plain(txs, (0.0, None) if a in closed else anchors[a])
    late = [(1, 1, dt.date(2030, 1, 1), 10**6, "buy", 5.0, 1.0, None, None, 0.0, 0.0, None, 1, "JPY")]
    tx = spark.createDataFrame([t for g in groups.values() for t in g] + late, TX)
    rows = [(a, 1, dt.date(2025, 1, 1), q, c, "JPY", 1, None) for a, (q, c) in anchors.items() if a not in closed]
    got = {r.account_id: r for r in replay.reconciled_positions(tx, spark.createDataFrame(rows, ANCHOR), ["id"]).collect()}
    assert set(got) == set(groups)
    kinds = set()
    for a, (coverage, q0, c0, rest, average, realized, stops) in expected.items():
        r = got[a]
        kinds.add((coverage, r.irregular))
        assert r.coverage == coverage, (a, r, expected[a])
        assert close(r.opening_quantity, q0) and close(r.opening_cost, c0) and close(r.residual_quantity, rest) and close(r.avg_cost, average) and close(r.realized, realized) and r.roc_stops == stops, (a, r, expected[a])
        assert r.closed == (a in closed) and r.tx_count == len(groups[a])
    assert {("full", False), ("partial", False), ("partial", True), ("partial_uncosted", False), ("unreconciled", False)} <= kinds


def test_replay_of_odd_ledgers(spark):
    tx = [(1, 1, DAY, 1, "buy", 10.0, None, 100.0, None, None, None, None, 1, "USD"), (2, 1, DAY, 1, "buy", None, None, None, None, None, None, None, 1, "JPY"), (3, 1, DAY, 1, "transfer_in", 5.0, None, 0.0, 0.0, None, None, None, 1, "JPY")]
    anchors = spark.createDataFrame([(1, 1, DAY, 10.0, 10.0, "JPY", 1, None), (2, 1, DAY, 3.0, 7.0, "JPY", 1, DAY), (3, 1, DAY, 5.0, 7.0, "JPY", 2, None)], ANCHOR)
    got = {r.account_id: r for r in replay.reconciled_positions(spark.createDataFrame(tx, TX), anchors, ["id"]).collect()}
    assert (got[1].coverage, got[1].tx_count, got[1].opening_quantity) == ("unreconciled", None, None)
    assert (got[2].coverage, got[2].opening_quantity, got[2].opening_cost, got[2].acquired_on) == ("partial", 3.0, 7.0, DAY)
    assert (got[3].coverage, got[3].avg_cost, got[3].costless_transfers, got[3].applies) == ("full", 0.0, 1, False)
    assert replay.reconciled_positions(spark.createDataFrame([], TX), anchors, ["id"]).collect() == []


def test_replay_rounds_as_one_row_after_the_other(spark):
    """Bits of the opening cost and of the average are those of a plain loop, also of positions of several days and of amounts beyond 2^63."""
    rng = random.Random(11)
    groups = {}
    for a in range(60):
        groups[a] = [(a, 1, DAY + dt.timedelta(i // 2), i, kind, float(rng.randint(1, 40)), None, rng.randint(1, 9_000_000) / 7.0, None, float(rng.randint(0, 999)), 0.0, None, 1, "JPY") for i, kind in enumerate(rng.choices(["buy", "sell"], [2, 1], k=40))]
    net = {a: sum(t[5] * (1 if t[4] == "buy" else -1) for t in txs) for a, txs in groups.items()}
    rows = [(a, 1, dt.date(2025, 1, 1), n + 1_000, 1e9, "JPY", 1, None) for a, n in net.items()]
    got = {r.account_id: r for r in replay.reconciled_positions(spark.createDataFrame([t for g in groups.values() for t in g], TX), spark.createDataFrame(rows, ANCHOR), ["id"]).collect()}
    for a, txs in groups.items():
        q, pool, share = 1_000.0, 0.0, 1_000.0
        for t in txs:
            if t[4] == "buy":
                q, pool = q + t[5], pool + (t[7] + t[9])
            else:
                keep = (q - t[5]) / q
                q, pool, share = q - t[5], pool * keep, share * keep
        assert got[a].opening_cost == ((net[a] + 1_000) * 1e9 - pool) / share


def test_large_amounts_keep_their_size(spark):
    x = spark.createDataFrame([(2.5e22,), (-2.5e22,), (0.125,), (-0.125,), (None,)], "x double").select(half_up(F.col("x"), 2).alias("x"))
    assert [r.x for r in x.collect()] == [2.5e22, -2.5e22, 0.13, -0.12, None]


# paths


MOVES = "account_id long, security_id long, trade_date date, id long, ref string, kind string, quantity double, split_ratio double"
STATEMENTS = "account_id long, security_id long, lot_seq int, as_of_date date, quantity double"
EPS = Q(1, 10**7)


def moved(t, q):
    return q + Q(t[6]) if t[5] in replay.ACQUIRES else q - Q(t[6]) if t[5] in ("sell", "transfer_out") else q * Q(t[7])


def undo(txs, held, until):
    q, changes = held, []
    for day in sorted({t[2] for t in txs}, reverse=True):
        if until is None or day < until:
            changes.append((day, q))
        for t in [t for t in txs if t[2] == day][::-1]:
            q = q - Q(t[6]) if t[5] in replay.ACQUIRES else q + Q(t[6]) if t[5] in ("sell", "transfer_out") else q / Q(t[7])
        if q < -EPS:
            return None
        q = Q(0) if abs(q) <= EPS else q
    return q, changes[::-1]


def recorded(txs, link, kind):
    return any(t[5] == kind and -7 <= (t[2] - link[3]).days <= 30 for t in txs)


def plain_path(txs, snaps, into, out):
    """(status, opening, changes) of one position."""
    virtual = lambda x, kind: (0, 0, x[3], -1, "", kind, x[4], None)
    order = lambda ts: sorted(ts, key=lambda t: (t[2], t[3]))
    if not snaps:
        txs = order([*txs, *(virtual(x, "transfer_in") for x in into if not recorded(txs, x, "transfer_in")), *(virtual(x, "transfer_out") for x in out if not recorded(txs, x, "transfer_out"))])
        found = undo(txs, Q(0), None)
        return ("closed", *found) if found else ("no_snapshot", None, None)
    if not txs and not into:
        return ("no_trades", None, None)
    lots = {}
    for s in sorted(snaps, key=lambda s: s[3]):
        lots.setdefault(s[2], []).append((s[3], Q(s[4])))
    starts = {v[0][0] for v in lots.values()}
    if len(starts) > 1:
        return ("lots_differ", None, None)
    first = starts.pop()
    if into and not any(t[2] < first for t in txs):
        arrived = sorted((x[3], Q(x[4])) for x in into if x[3] <= first)
        if not arrived:
            return ("no_earlier_trades", None, None)
        q = opening = sum(v[0][1] for v in lots.values()) - sum(x[1] for x in arrived)
        if opening < -EPS:
            return ("inconsistent", None, None)
        changes = {}
        for day, n in arrived:
            q += n
            if day < first:
                changes[day] = q
        return ("linked", opening, sorted(changes.items()))
    txs = order([*txs, *(virtual(x, "transfer_in") for x in into if x[3] < first and not recorded(txs, x, "transfer_in"))])
    days = {t[2] for t in txs}
    anchor = next((d for d in sorted({s[3] for s in snaps}) if d not in days), first)
    if anchor == first and not any(d < first for d in days):
        return ("no_earlier_trades", None, None)
    held = sum([q for d, q in v if d <= anchor][-1] for v in lots.values())
    found = undo([t for t in txs if t[2] <= anchor], held, first)
    return ("traced", *found) if found else ("inconsistent", None, None)


def test_paths_equal_a_plain_walk(spark):
    rng = random.Random(3)
    day = lambda lo, hi: DAY + dt.timedelta(rng.randint(lo, hi))
    groups, snaps, links = {}, {}, []
    for a in range(300):
        n, txs, q = rng.choice([0, 1, 3, 12]), [], 0
        for i in range(n):
            kind = rng.choices(["buy", "sell", "transfer_in", "transfer_out", "split"], [5, 2, 1, 1, 1])[0]
            txs.append((a, 1, day(0, 60), i, f"{a}-{i}", kind, float(rng.randint(1, 9)), rng.choice([2.0, 0.5]) if kind == "split" else None))
        groups[a] = sorted(txs, key=lambda t: (t[2], t[3]))
        q = Q(rng.choice([0, 5, 60]))
        snaps[a] = []
        if rng.random() < 0.8:
            dates = sorted({day(0, 90) for _ in range(rng.choice([1, 2, 4]))})
            begin = {0: 0, 1: rng.choice([0, 0, 1])}
            for lot in range(rng.choice([1, 1, 2])):
                for d in dates[begin[lot] :]:
                    held = q
                    for t in groups[a]:
                        if t[2] <= d:
                            held = moved(t, held)
                    snaps[a].append((a, 1, lot, d, float(held) if lot == 0 else 3.0))
        if rng.random() < 0.3:
            links.append((1, rng.randrange(300), a, day(0, 70), float(rng.randint(1, 20)), [f"{a}-{rng.randrange(4)}"]))
    absorbed = {r for x in links for r in x[5]}
    keys = {a for a in groups if groups[a] or snaps[a]}
    expected = {}
    for a in range(300):
        txs = [t for t in groups[a] if t[4] not in absorbed]
        into, out = [x for x in links if x[2] == a], [x for x in links if x[1] == a]
        if txs or snaps[a] or into:
            expected[a] = plain_path(txs, snaps[a], into, out)
    assert keys
    tx = spark.createDataFrame([t for g in groups.values() for t in g], MOVES)
    got = paths.quantity_paths(tx, spark.createDataFrame([s for g in snaps.values() for s in g], STATEMENTS), ["id"], spark.createDataFrame(links, paths.LINKS))
    rows = {r.account_id: r for r in got.collect()}
    assert set(rows) == set(expected)
    for a, (status, opening, changes) in expected.items():
        r = rows[a]
        assert r.status == status and close(r.opening, opening), (a, r, expected[a])
        assert (r.changes is None) == (changes is None) and (changes is None or [c.day for c in r.changes] == [d for d, _ in changes] and all(close(c.quantity, q) for c, (_, q) in zip(r.changes, changes, strict=True))), (a, r, expected[a])
    assert {r.status for r in rows.values()} >= {"traced", "linked", "closed", "no_snapshot", "no_trades", "no_earlier_trades", "lots_differ", "inconsistent"}
    # on every day a path is its last change, or the opening quantity
    on = {(r.account_id, r.day): (r.quantity, r.estimated) for r in paths.path_days(got, "2020-01-10", "2020-02-10").collect()}
    for a, r in rows.items():
        for d in (dt.date(2020, 1, 10), dt.date(2020, 1, 25), dt.date(2020, 2, 10)):
            if r.changes is not None and (r.before is None or d < r.before):
                seen = [c.quantity for c in r.changes if c.day <= d]
                assert on[a, d] == (seen[-1], False) if seen else on[a, d] == (r.opening, r.opening > 1e-7)
            else:
                assert (a, d) not in on


def test_paths_of_empty_tables(spark):
    assert paths.quantity_paths(spark.createDataFrame([], MOVES), spark.createDataFrame([], STATEMENTS), ["id"]).collect() == []
