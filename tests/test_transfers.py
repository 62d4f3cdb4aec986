"""Transfers between accounts against a plain version that looks at every record."""

import datetime as dt
import random

from folioforge.operators import transfers

DAY = dt.date(2020, 1, 1)
TX = "account_id long, security_id long, trade_date date, settle_date date, id long, kind string, quantity double, unit_price double, split_ratio double, ref string"
STATED = "account_id long, security_id long, lot_seq int, as_of_date date, quantity double, avg_cost double"
EPS = 1e-7


def mean(rows):
    return None if not rows or any(p is None or p <= 0 for _, p in rows) or sum(q for q, _ in rows) <= 0 else sum(q * p for q, p in rows) / sum(q for q, _ in rows)


def balances(txs):
    q, out = 0.0, {}
    for t in sorted(txs, key=lambda t: (t[2], t[4])):
        step = {"buy": 1, "transfer_in": 1, "sell": -1, "transfer_out": -1}.get(t[5])
        if step:
            q += step * t[6]
            out[t[2]] = q
    return out


def statement_totals(snaps):
    out = {}
    for d in sorted({s[3] for s in snaps}):
        lots = {}
        for s in sorted(snaps, key=lambda s: s[3]):
            if s[3] <= d:
                lots[s[2]] = s
        out[d] = (sum(s[4] for s in lots.values()), mean([(s[4], s[5]) for s in lots.values() if s[4] > EPS]))
    return out


def departures(txs, snaps):
    """(date, account, quantity, source, cost, closed) of one security's accounts."""
    out = []
    for a in {t[0] for t in txs} | {s[0] for s in snaps}:
        mine, own = [t for t in txs if t[0] == a], [s for s in snaps if s[0] == a]
        net = {}
        for t in mine:
            if t[5] in ("transfer_in", "transfer_out"):
                net[t[2]] = net.get(t[2], 0) + (t[6] if t[5] == "transfer_in" else -t[6])
        spare = {d: n for d, n in net.items() if n > EPS}
        for d in sorted(net):
            left = -net[d]
            for e in sorted(spare, key=lambda e: (abs((e - d).days), e)):
                if left > EPS and abs((e - d).days) <= 10:
                    used = min(left, spare[e])
                    left, spare[e] = left - used, spare[e] - used
            if left > EPS:
                out.append((d, a, left, "ledger", mean([(t[6], t[7]) for t in mine if t[5] == "transfer_out" and t[2] == d]), abs(balances(mine).get(d, 1)) <= EPS))
        before = None
        for d, (total, cost) in statement_totals(own).items():
            if before and before[1] > EPS and total <= EPS and not any(t[5] in ("sell", "transfer_out") and before[0] < t[2] <= d for t in mine):
                out.append((d, a, before[1], "snapshot", before[2], True))
            before = (d, total, cost)
    return sorted(out, key=lambda o: (o[0], o[1], o[3]))


def appears(day, txs, snaps):
    """(effective, quantity, cost, kind, early, refs) or None, from every record of the account."""
    lo, hi = day - dt.timedelta(7), day + dt.timedelta(30)
    moved = [t for t in txs if t[5] == "transfer_in" and (lo <= t[2] <= hi or lo <= t[3] <= hi)]
    prior = [t for t in txs if t[2] < lo and t not in moved]
    held = [s for s in snaps if s[3] < lo and s[4] > EPS]
    if not moved and not any(t[2] >= lo for t in txs) and not any(s[3] >= lo for s in snaps):
        return None
    if held or any(t[5] != "transfer_in" for t in prior):
        first = min([t[2] for t in txs] + [s[3] for s in snaps])
        there = statement_totals(snaps)
        return (first, there[first][0] if first in there else balances(txs).get(first, 0.0), None, "other", True, [])
    rows = sorted({t[4]: t for t in prior + moved}.values(), key=lambda t: (t[2], t[4]))
    if rows:
        return (day, sum(t[6] for t in rows), mean([(t[6], t[7]) for t in rows]), "transfer_in", False, [t[9] for t in rows])
    snap = min((s[3] for s in snaps if s[3] >= lo), default=None)
    trades = [t for t in txs if t[2] >= lo and t[5] in ("buy", "transfer_in", "sell", "transfer_out")]
    trade = min((t[2] for t in trades), default=None)
    if trade is not None and (snap is None or trade < snap):
        on = [t for t in trades if t[2] == trade]
        return (trade, balances(on)[trade], None, "buy" if any(t[5] == "buy" for t in on) else "other", False, [])
    return (snap, *statement_totals(snaps)[snap], "snapshot", False, []) if snap else None


def plain(txs, snaps, manual):
    out, consumed = [], {m[2] for m in manual if m[2] is not None}
    decided = {(m[1], m[3]): m for m in manual}
    accounts = {t[0] for t in txs} | {s[0] for s in snaps}
    see = lambda day, a: appears(day, [t for t in txs if t[0] == a], [s for s in snaps if s[0] == a])
    for m in manual:
        if m[2] is not None:
            found = see(m[3], m[2]) if m[2] in accounts else None
            out.append((m[1], m[3], m[4], "manual", m[2], "manual", tuple(found[5]) if found and found[3] == "transfer_in" and abs(found[1] - m[4]) <= EPS else ()))
    for day, a, q, source, cost, closed in departures(txs, snaps):
        if (a, day) in decided:
            if decided[a, day][2] is None:
                out.append((a, day, q, source, None, "dismissed", ()))
            continue
        found = []
        for b in accounts - consumed - {a}:
            x = see(day, b)
            if x and abs(x[1] - q) <= EPS:
                same = abs(x[2] - cost) / cost <= 0.02 if cost and x[2] else None
                found.append((b, x, same))
        pool = [f for f in found if not f[1][4] and f[2] is not False and f[1][3] in ("snapshot", "transfer_in") and (f[1][0] - day).days <= 400]
        pool = [f for f in pool if f[2]] or pool
        firsts = [f for f in pool if f[1][0] == min(p[1][0] for p in pool)]
        if len(firsts) == 1:
            consumed.add(firsts[0][0])
            out.append((a, day, q, source, firsts[0][0], "auto", tuple(firsts[0][1][5])))
        elif found or source == "ledger" and closed:
            out.append((a, day, q, source, None, "unresolved", ()))
    return out


def world(rng):
    day = lambda lo=0, hi=900: DAY + dt.timedelta(rng.randint(lo, hi))
    txs, snaps, manual = [], {}, {}
    add = lambda a, s, d, kind, q, p: txs.append((a, s, d, d + dt.timedelta(rng.choice([0, 2, 5])), len(txs), kind, float(q), p, None, f"r{len(txs)}"))
    for s in range(12):
        for a in range(25):
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                kind, q = rng.choices(["buy", "sell", "transfer_in", "transfer_out", "dividend"], [2, 1, 3, 4, 1])[0], rng.choice([1, 2, 3])
                add(a, s, day(), kind, q, rng.choice([None, 100.0, 101.0, 150.0]))
                if kind == "transfer_out" and rng.random() < 0.5:
                    d = txs[-1][2] + dt.timedelta(rng.randint(-12, 40))
                    add(rng.choice([a, rng.randrange(25)]), s, d, "transfer_in", q, rng.choice([None, 100.0]))
            if rng.random() < 0.4:
                for d in sorted({day() for _ in range(rng.choice([1, 2, 4]))}):
                    for lot in range(rng.choice([1, 1, 2])):
                        snaps[a, s, lot, d] = (a, s, lot, d, float(rng.choice([0, 0, 1, 2, 3])), rng.choice([None, 100.0, 150.0]))
        for _ in range(2):
            manual[rng.randrange(25), s] = (s, rng.randrange(25), rng.choice([None, rng.randrange(25)]), rng.choice([t[2] for t in txs]), 2.0)
    return txs, list(snaps.values()), list(manual.values())


def test_resolution_equals_a_plain_sweep(spark):
    kinds = set()
    for seed in (1, 2):
        txs, snaps, manual = world(random.Random(seed))
        manual = list({(m[0], m[1], m[3]): m for m in manual}.values())
        manual += [(s, a, None, d, q) for s in range(12) for d, a, q, *_ in departures([t for t in txs if t[1] == s], [x for x in snaps if x[1] == s])[:1] if not any(m[0] == s and m[1] == a and m[3] == d for m in manual)]
        tx, st = spark.createDataFrame(txs, TX), spark.createDataFrame(snaps, STATED)
        got = transfers.resolved(tx, st, ["id"], spark.createDataFrame(manual, transfers.MANUAL)).collect()
        rows = sorted((r.security_id, r.from_account, r.date, r.quantity, r.source, r.to_account, r.outcome, tuple(r.absorbed)) for r in got if r.outcome)
        expected = sorted(((s, *x) for s in range(12) for x in plain([t for t in txs if t[1] == s], [x for x in snaps if x[1] == s], [m for m in manual if m[0] == s])), key=str)
        assert sorted(rows, key=str) == expected
        kinds |= {(r.source, r.outcome) for r in got}
        left = sorted((o.security_id, o.date, o.account_id, o.quantity, o.source, o.closed) for o in transfers.ledger_departures(tx, ["id"]).unionByName(transfers.snapshot_departures(st, tx)).collect())
        assert left == sorted((s, d, a, q, source, closed) for s in range(12) for d, a, q, source, _, closed in departures([t for t in txs if t[1] == s], [x for x in snaps if x[1] == s]))
    assert kinds >= {("ledger", "auto"), ("snapshot", "auto"), ("ledger", "unresolved"), ("manual", "manual"), ("ledger", "dismissed")}


def test_no_transfers(spark):
    assert transfers.resolved(spark.createDataFrame([], TX), spark.createDataFrame([], STATED), ["id"]).collect() == []
