"""Lots of a statement's rows, ids of what is new, a user's choices, points of coins: small inputs and plain versions."""

import datetime as dt
import random

from folioforge.operators import history, lots

D = dt.date
ROWS = "account_id long, security_id long, row_id long, section string, label string, quantity double, cost double"
LOTS = "account_id long, security_id long, lot_seq long, label string, quantity double, cost double"


def distance(a, b):
    return 0.0 if a is None and b is None else float("inf") if a is None or b is None else abs(a - b)


def every_pair(rows, known):
    """The nearest pair of all that are free, again and again."""
    pairs = sorted((distance(r[1], t[1]), distance(r[2], t[2]), r[0], t[0]) for r in rows for t in known)
    out, used, taken = set(), set(), set()
    for _, _, r, t in pairs:
        if r not in used and t not in taken:
            out.add((r, t))
            used.add(r)
            taken.add(t)
    return out


def test_nearest_pairs():
    rng = random.Random(2)
    some = lambda n: [(i, rng.choice([None, *[float(x) for x in range(8)]]), rng.choice([None, 1.0, 2.0, 5.0])) for i in range(n)]
    for _ in range(400):
        rows, known = some(rng.randrange(9)), some(rng.randrange(9))
        assert set(lots.nearest(rows, known)) == every_pair(rows, known)
    many = [(i, float(i % 977), float(i % 13)) for i in range(4_000)]
    assert len(set(lots.nearest(many, many[::-1]))) == 4_000


def by_label(rows, known):
    parts = lambda label: ((label or "").partition("|")[0], (label or "").partition("|")[2] == "", (label or "").partition("|")[2])
    out, free = {}, sorted(known)
    for r in sorted(rows):
        hit = next((t for t in free if (t[1] or "") == (r[1] or "")), None)
        if hit:
            out[r[0]] = hit[0]
            free.remove(hit)
    for kind in {parts(r[1])[0] for r in rows}:
        mine = sorted((parts(r[1])[1:], r[0]) for r in rows if r[0] not in out and parts(r[1])[0] == kind)
        left = sorted((parts(t[1])[1:], t[0]) for t in free if parts(t[1])[0] == kind)
        out |= {r: t for (_, r), (_, t) in zip(mine, left, strict=False)}
    return set(out.items())


def test_assigned_and_diffed(spark):
    rng = random.Random(4)
    label = lambda: rng.choice([None, "", "p", "q", *[f"p|{y}" for y in range(2020, 2024)], "q|2021"])
    number = lambda n: rng.choice([None, *[float(x) for x in range(n)]])
    rows = [(a, s, i, "point" if s == 0 else rng.choice(["stock", None]) if s == 1 else "fund", label(), number(3), number(6)) for a in range(8) for s in range(3) for i in range(rng.randrange(7))]
    known = [(a, s, i * 2, label(), number(3), number(6)) for a in range(9) for s in range(3) for i in range(rng.randrange(7))]
    want = set()
    for key in {r[:2] for r in rows}:
        mine, old = [r for r in rows if r[:2] == key], [t for t in known if t[:2] == key]
        found = by_label([(r[2], r[4]) for r in mine], [(t[2], t[3]) for t in old]) if key[1] == 0 else every_pair([(r[2], r[6], r[5]) for r in mine], [(t[2], t[5], t[4]) for t in old])
        want |= {(*key, r, t) for r, t in found}
    r, t = spark.createDataFrame(rows, ROWS), spark.createDataFrame(known, LOTS)
    got = {tuple(x) for x in lots.assigned(r, t).select("account_id", "security_id", "row_id", "lot_seq").collect()}
    assert got == want

    diff = lots.diffed(r, t).collect()
    old, new = {x[:3]: x[4:] for x in known}, {x[:3]: x[5:] for x in rows}
    assert {(x.account_id, x.security_id, x.row_id, x.lot_seq) for x in diff if x.status not in ("new", "missing")} == want
    for x in diff:
        key = (x.account_id, x.security_id)
        if x.status == "missing":
            assert old[(*key, x.lot_seq)][0] not in (None, 0.0) and x.row_id is None
        elif x.status == "new":
            assert (*key, x.lot_seq) not in old
        else:
            a, b = old[(*key, x.lot_seq)], new[(*key, x.row_id)]
            assert x.status == ("qty_changed" if a[0] != b[0] else "cost_changed" if a[1] != b[1] else "unchanged")
    fresh = [(x.account_id, x.security_id, x.lot_seq) for x in diff if x.status == "new"]
    assert len(set(fresh)) == len(fresh) == len(rows) - len(want)
    assert lots.diffed(r.limit(0), t.limit(0)).count() == 0
    assert {x.lot_seq for x in lots.diffed(spark.createDataFrame([(1, 1, 5, "fund", None, 1.0, 1.0), (1, 1, 9, "fund", None, 1.0, 1.0)], ROWS), t.limit(0)).collect()} == {0, 1}


def test_ids_are_given_bucket_by_bucket(spark):
    d = spark.createDataFrame([(f"k{i}",) for i in range(50)], "k string")
    got = [lots.new_ids(d, "k", 7, n).collect() for n in (1, 6, 6)]
    assert all(sorted(r.id for r in x) == list(range(8, 58)) for x in got)
    assert {(r.k, r.id) for r in got[1]} == {(r.k, r.id) for r in got[2]} and lots.new_ids(d.limit(0), "k", 7).count() == 0


def test_ensured(spark):
    kind = "batch string, ref int, account string, name string, name_key string, code string, security_id long"
    t = spark.createDataFrame([("a", 0, "x", "N", "n", "1234", None), ("a", 1, "y", "M", "m", None, None), ("a", 2, "y", "M", "m", None, 99), ("a", 3, "y", "O", "o", None, 3), ("a", 4, "z", "P", "p", None, None), ("b", 5, " ", "Q", "q", None, None), ("b", 6, "w", "R", "r", None, None), ("c", 7, "z", "P2", "p", None, None), ("c", 8, "z", "S", "s", "", None)], kind)
    accounts = spark.createDataFrame([(4, "x")], "account_id long, name string")
    securities = spark.createDataFrame([(1, "1234", "zz"), (3, None, "u"), (6, None, "s"), (5, None, "s")], "security_id long, code string, name_key string")
    aliases = spark.createDataFrame([("m", 3)], "alias string, security_id long")
    got, opened, made = lots.ensured(t, accounts, securities, aliases)
    assert {r.ref: (r.account_id, r.new_account, r.known_security, r.new_security) for r in got.collect()} == {0: (4, False, 1, None), 1: (5, True, 3, None), 2: (5, True, 3, None), 3: (5, True, 3, None), 4: (6, True, None, 7), 7: (6, True, None, 7), 8: (6, True, 5, None)}
    assert {tuple(r) for r in opened.collect()} == {(5, "y"), (6, "z")} and [tuple(r) for r in made.collect()] == [(7, None, "P", "p")]
    none = lots.ensured(t, accounts.limit(0), securities.limit(0), aliases.limit(0))
    assert sorted(r.account_id for r in none[1].collect()) == [1, 2, 3] and none[2].count() == 5
    assert [x.count() for x in lots.ensured(t.limit(0), accounts, securities, aliases)] == [0, 0, 0]


def test_choices(spark):
    kind = "name string, security_id long, matched_by string, included boolean, confidence double, duplicate boolean"
    names = [("new", None, None, False, 0.9, False), ("old", None, None, False, 0.9, False), ("older", 5, "price", True, 0.9, False), ("o l d", None, None, False, 0.6, None), ("own", 5, "code", True, 0.9, False), ("own", None, None, False, 0.9, True), ("left", 5, "quantity", True, 0.9, False), (None, None, None, False, 0.9, False), ("other", None, None, False, 0.9, False)]
    members = spark.createDataFrame([("new", "new"), ("old", "new"), ("older", "new"), ("left", "left")], "name string, group string")
    choices = spark.createDataFrame([("old", 1), ("older", 2), ("own", 3), ("left", None)], "name string, security_id long")
    got = [tuple(r)[:4] for r in lots.overridden(spark.createDataFrame(names, kind), choices, members).collect()]
    want = [("new", 1, "manual", True), ("old", 1, "manual", True), ("older", 2, "manual", True), ("o l d", 1, "manual", False), ("own", 5, "code", True), ("own", 3, "manual", False), ("left", None, "unmatched", False), (None, None, None, False), ("other", None, None, False)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_points_of_coins(spark):
    answers = [("a", "value", D(2024, 1, 1), 5.0, 9.0, None), ("a", "balance", D(2024, 1, 1), None, 2.0, None), ("a", "balance", D(2024, 1, 2), None, None, None), ("b", "value", D(2024, 1, 1), None, 3.0, 8.0), ("b", None, D(2024, 1, 2), 4.0, None, None), ("b", "price", D(2024, 1, 1), 1.0, 1.0, 7.0), ("b", "price", None, 1.0, 1.0, 7.0)]
    d = spark.createDataFrame(answers, "symbol string, metric string, t date, value double, balance double, price double")
    got = {(r.symbol, r.kind, r.t.day, r.amount) for r in history.coin_points(d).collect()}
    assert got == {("a", "value", 1, 5.0), ("a", "quantity", 1, 2.0), ("b", "quantity", 1, 3.0), ("b", "value", 2, 4.0), ("b", "price", 1, 7.0)}
