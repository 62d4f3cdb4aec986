"""DuckDB SQL for the queries of ledgers.py: the rows of a position one after the other, in recursive table expressions."""

from __future__ import annotations

from .ledgers import ANCHOR, ARRIVES, CLOSED, CODES, DEPARTS, FROM, LATER_LOT, LOT_COST, LOT_FROM, LOT_QUANTITY, LOT_REPORTED, MOVED, PART, REF, RULES, SURE, TO
from .oracle import LEDGER, PRICES, SNAP, r
from .wealth_sql import COLUMNS, DELTA, INS, LOTS, MULT, PROCEEDS, RATES, cost

RICH = f"{LEDGER}, {SNAP}, rich AS (SELECT *, ({MULT})::DOUBLE AS mult, ({DELTA})::DOUBLE AS delta, ({PROCEEDS})::DOUBLE AS proceeds FROM (SELECT *, {COLUMNS} FROM ledger))"
DAY = "DATE '1998-06-30'"
G = "account_id, security_id"
ORDER = "trade_date, l_orderkey, l_linenumber, l_partkey"
ANCHORS = f"""net AS (SELECT {G}, sum(delta)::DOUBLE AS net FROM rich WHERE kind <> 'split' AND trade_date <= {DAY} GROUP BY ALL),
anc AS (SELECT {G}, as_of_date, {', '.join(f'{x} AS {k}' for k, x in ANCHOR.items())} FROM (SELECT {G}, max(as_of_date) AS as_of_date, arg_max(quantity, as_of_date) AS s_quantity, arg_max(cost, as_of_date) AS s_cost, arg_max(bought, as_of_date) AS bought FROM snap WHERE as_of_date <= {DAY} AND NOT {CLOSED} GROUP BY ALL) LEFT JOIN net USING ({G}))"""
USED = f"""used AS (SELECT x.*, a.as_of_date IS NULL AS closed, coalesce(a.quantity, 0) AS held, a.avg_cost AS held_cost, a.lots, a.acquired_on AS held_since, a.currency AS held_currency, row_number() OVER (PARTITION BY x.account_id, x.security_id ORDER BY {ORDER}) AS n,
  kind IN ('buy', 'reinvest', 'transfer_in') AS adds, kind IN ('sell', 'transfer_out') AS leaves, abs(coalesce(net_amount, 0))::DOUBLE AS back
  FROM rich x LEFT JOIN anc a USING ({G}) WHERE a.as_of_date IS NULL OR trade_date <= a.as_of_date),
facts AS (SELECT {G}, any_value(closed) AS closed, any_value(held) AS held, any_value(held_cost) AS held_cost, any_value(lots) AS lots, any_value(held_since) AS held_since, any_value(divisor)::DOUBLE AS divisor, bool_or(NOT closed AND currency <> held_currency) AS fremd, count(*) AS tx_count, min(trade_date) AS first_trade, max(trade_date) AS last_trade,
  sum(CASE WHEN kind = 'dividend' THEN abs(coalesce(net_amount, 0)) ELSE 0 END)::DOUBLE AS income, sum(abs(tax))::DOUBLE AS withheld, min(CASE WHEN adds THEN trade_date END) AS first_buy FROM used GROUP BY {G})"""


def one_after_the_other(name: str, start: str, columns: list[str], steps: list[str]) -> str:
    """name: the state after each row of used; start: a table with the groups' first state."""
    return f"""{name} AS (SELECT {G}, 0::BIGINT AS n, {', '.join(columns)} FROM {start}
  UNION ALL SELECT s.account_id, s.security_id, u.n, {', '.join(steps)} FROM {name} s JOIN used u ON u.account_id = s.account_id AND u.security_id = s.security_id AND u.n = s.n + 1)"""


def last(name: str) -> str:
    return f"(SELECT {G}, max_by(x, x.n) AS x FROM {name} x GROUP BY {G})"


LEFT, COST = "(CASE WHEN abs(s.q - abs(u.quantity)) <= 1e-10 * abs(s.q + abs(u.quantity)) THEN 0 ELSE s.q - abs(u.quantity) END)", "(u.proceeds + abs(u.fee))"
SALE = "u.leaves AND s.q > 0"
GREW = "CASE WHEN u.kind = 'split' AND u.mult <> 1 THEN u.mult WHEN u.kind = 'split' AND s.q <> 0 THEN (s.q + coalesce(u.delta, 0)) / s.q ELSE 1 END"
REPLAY = f"""WITH RECURSIVE {RICH}, {ANCHORS}, {USED},
{one_after_the_other('w1', 'facts WHERE NOT fremd', ['1::DOUBLE AS alpha', '0::DOUBLE AS beta'], ['s.alpha * coalesce(u.mult, 1)', 's.beta * coalesce(u.mult, 1) + coalesce(u.delta, 0)'])},
q0 AS (SELECT f.*, CASE WHEN abs((held - x.beta) / x.alpha) <= 1e-7 THEN 0 ELSE (held - x.beta) / x.alpha END AS q0 FROM facts f LEFT JOIN {last('w1')} USING ({G})),
{one_after_the_other('w2', 'q0 WHERE q0 >= 0', ['q0 AS q', '0::DOUBLE AS a', 'q0 / divisor AS b', 'false AS bad', '0 AS costless'], [
    f'CASE WHEN u.leaves THEN {LEFT} ELSE s.q * coalesce(u.mult, 1) + coalesce(u.delta, 0) END',
    f"CASE WHEN u.adds THEN s.a + {COST} WHEN {SALE} THEN s.a * ({LEFT} / s.q) WHEN u.kind = 'return_of_capital' THEN s.a - u.back ELSE s.a END",
    f'CASE WHEN {SALE} THEN s.b * ({LEFT} / s.q) ELSE s.b END', f's.bad OR (u.leaves AND (s.q <= 0 OR {LEFT} < 0))', f's.costless + (u.adds AND {COST} = 0)::INTEGER'])},
cz AS (SELECT q.*, x.bad, x.costless, CASE WHEN x.b <> 0 THEN (held * held_cost / divisor - x.a) / x.b END AS c0, CASE WHEN x.b = 0 THEN 'full' WHEN held_cost IS NULL THEN 'partial_uncosted' WHEN (held * held_cost / divisor - x.a) / x.b < 0 THEN 'unreconciled' ELSE 'partial' END AS coverage FROM q0 q JOIN {last('w2')} USING ({G})),
{one_after_the_other('w3', "cz WHERE coverage <> 'unreconciled'", ['q0 AS q', 'coalesce(q0 * c0 / divisor, 0)::DOUBLE AS pool', 'q0 AS rest', '0::DOUBLE AS realized', '0 AS sales', '0::DOUBLE AS sold', '0 AS stops'], [
    f"CASE WHEN {SALE} THEN {LEFT} WHEN u.adds THEN s.q + abs(u.quantity) WHEN u.kind = 'split' AND u.mult <> 1 THEN s.q * u.mult WHEN u.kind = 'split' AND s.q <> 0 THEN s.q + coalesce(u.delta, 0) ELSE s.q END",
    f"CASE WHEN {SALE} THEN s.pool * ({LEFT} / s.q) WHEN u.adds THEN s.pool + {COST} WHEN u.kind = 'return_of_capital' THEN greatest(s.pool - u.back, 0) ELSE s.pool END",
    f"CASE WHEN {SALE} THEN s.rest * ({LEFT} / s.q) ELSE s.rest * ({GREW}) END",
    f"s.realized + CASE WHEN {SALE} AND u.kind = 'sell' THEN u.proceeds - abs(u.fee) - (s.pool - s.pool * ({LEFT} / s.q)) ELSE 0 END", f"s.sales + (coalesce({SALE} AND u.kind = 'sell', false))::INTEGER",
    f"s.sold + CASE WHEN {SALE} AND u.kind = 'sell' THEN s.pool - s.pool * ({LEFT} / s.q) ELSE 0 END", "s.stops + (u.kind = 'return_of_capital' AND s.pool < u.back)::INTEGER"])},
fin AS (SELECT q.*, c.c0, c.bad, c.costless, coalesce(c.coverage, 'unreconciled') AS cov, x.pool, CASE WHEN x.rest IS NOT NULL THEN greatest(x.rest, 0) END AS rest, x.realized, x.sales, x.sold, x.stops FROM q0 q LEFT JOIN cz c USING ({G}) LEFT JOIN {last('w3')} USING ({G})),
av AS (SELECT *, CASE WHEN cov = 'full' AND held > 0 THEN pool * divisor / held WHEN cov = 'partial' THEN held_cost END AS av FROM fin)
"""

#: Trades undone one after the other from the anchor; at the start of a day the quantity is checked and settled.
PATHS = f"""WITH RECURSIVE {RICH},
st AS (SELECT {G}, 0 AS lot_seq, as_of_date, {LOT_QUANTITY} AS quantity FROM snap WHERE NOT {CLOSED} AND as_of_date >= {LOT_FROM} UNION ALL SELECT {G}, 1, as_of_date, 10 FROM snap WHERE NOT {CLOSED} AND as_of_date >= {LOT_FROM} AND {LATER_LOT}),
mv AS (SELECT * FROM rich WHERE mult IS NOT NULL),
f AS (SELECT {G}, min(s) AS first, max(s) AS latest FROM (SELECT {G}, lot_seq, min(as_of_date) AS s FROM st GROUP BY ALL) GROUP BY ALL),
fr AS (SELECT {G}, min(as_of_date) AS free FROM (SELECT {G}, as_of_date FROM st EXCEPT SELECT {G}, trade_date FROM mv) GROUP BY ALL),
an AS (SELECT {G}, first, latest, coalesce(free, first) AS anchor FROM f LEFT JOIN fr USING ({G})),
hl AS (SELECT {G}, sum(q)::DOUBLE AS held FROM (SELECT {G}, lot_seq, arg_max(quantity, as_of_date) AS q FROM st JOIN an USING ({G}) WHERE as_of_date <= anchor GROUP BY ALL) GROUP BY ALL),
ps AS (SELECT {G}, first, latest, anchor, CASE WHEN first IS NULL THEN 0 ELSE held END AS held, t.early FROM (SELECT {G} FROM an UNION SELECT {G} FROM mv) LEFT JOIN an USING ({G}) LEFT JOIN hl USING ({G}) LEFT JOIN (SELECT {G}, min(trade_date) AS early FROM mv GROUP BY ALL) t USING ({G})),
un AS (SELECT mv.account_id, mv.security_id, trade_date, mult, delta, first, row_number() OVER w AS n, lead(trade_date) OVER w IS DISTINCT FROM trade_date AS ends FROM mv JOIN ps USING ({G}) WHERE first IS NULL OR trade_date <= anchor WINDOW w AS (PARTITION BY mv.account_id, mv.security_id ORDER BY trade_date DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC)),
wk AS (SELECT {G}, 0::BIGINT AS n, held AS q, false AS bad, held AS after, NULL::DATE AS day FROM ps
  UNION ALL SELECT w.account_id, w.security_id, u.n, CASE WHEN u.ends AND abs((w.q - u.delta) / u.mult) <= 1e-7 THEN 0 ELSE (w.q - u.delta) / u.mult END, w.bad OR (u.ends AND (w.q - u.delta) / u.mult < -1e-7), CASE WHEN w.day IS DISTINCT FROM u.trade_date THEN w.q ELSE w.after END, u.trade_date
  FROM wk w JOIN un u ON u.account_id = w.account_id AND u.security_id = w.security_id AND u.n = w.n + 1),
en AS (SELECT {G}, arg_max(q, n) AS opening, bool_or(bad) AS bad FROM wk GROUP BY ALL),
sx AS (SELECT ps.*, opening, CASE WHEN first IS NULL THEN CASE WHEN bad THEN 'no_snapshot' ELSE 'closed' END WHEN early IS NULL THEN 'no_trades' WHEN first <> latest THEN 'lots_differ' WHEN anchor = first AND early >= first THEN 'no_earlier_trades' WHEN bad THEN 'inconsistent' ELSE 'traced' END AS status FROM ps JOIN en USING ({G})),
ch AS (SELECT {G}, day, any_value(after) AS quantity FROM wk JOIN sx USING ({G}) WHERE day IS NOT NULL AND status IN ('traced', 'closed') AND (first IS NULL OR day < first) GROUP BY ALL)"""

#: Trades and statements of the transfer queries; days: net transfers of a position's day; left: after cancelling pair by pair.
MOVES = f"""WITH RECURSIVE {RICH},
m0 AS (SELECT * EXCLUDE (account_id, mult, delta, proceeds), floor(gross / quantity)::DOUBLE AS price, {REF} AS ref, {', '.join(f'{x} AS {k}' for k, x in MOVED.items())}, {ARRIVES} AS way FROM rich),
tx AS (SELECT account_id::BIGINT AS account_id, security_id, trade_date AS day, CASE tx_type WHEN 'sell' THEN 'sell' ELSE 'buy' END AS kind, quantity::DOUBLE AS q, price, ref FROM m0 WHERE NOT {DEPARTS} AND l_partkey % 5 = 0
  UNION ALL SELECT account_id, security_id, trade_date, 'transfer_out', quantity, price, ref || '-out' FROM m0 WHERE {DEPARTS}
  UNION ALL SELECT other, security_id, trade_date + (l_partkey % 40)::INTEGER, 'transfer_in', quantity, price, ref || '-in' FROM m0 WHERE {DEPARTS} AND way = 'ledger'
  UNION ALL SELECT account_id, security_id, trade_date + (l_partkey % 14)::INTEGER, 'transfer_in', quantity - 1, price, ref || '-in' FROM m0 WHERE {DEPARTS} AND way = 'back'
  UNION ALL SELECT other, security_id, trade_date + 3, 'transfer_in', quantity + 1, price, ref || '-in' FROM m0 WHERE {DEPARTS} AND way = 'other quantity'),
st AS (SELECT account_id, security_id, day, max(q) AS q, max(price) AS price FROM (SELECT other::BIGINT AS account_id, security_id, trade_date + (l_partkey % 500)::INTEGER AS day, quantity::DOUBLE AS q, price FROM m0 WHERE {DEPARTS} AND way = 'statement'
  UNION ALL SELECT account_id, security_id, trade_date, quantity, price FROM m0 WHERE l_partkey % 32 = 4 UNION ALL SELECT account_id, security_id, trade_date + 30, 0, price FROM m0 WHERE l_partkey % 32 = 4) GROUP BY ALL),
sw AS (SELECT *, lag(q) OVER w AS was, lag(day) OVER w AS since, lag(CASE WHEN q > 1e-7 AND price > 0 THEN price END) OVER w AS was_cost FROM st WINDOW w AS (PARTITION BY account_id, security_id ORDER BY day)),
fell AS (SELECT security_id, account_id, day AS date, was AS quantity, was_cost AS cost FROM sw WHERE was > 1e-7 AND q <= 1e-7 AND NOT EXISTS (SELECT 1 FROM tx t WHERE t.account_id = sw.account_id AND t.security_id = sw.security_id AND kind IN ('sell', 'transfer_out') AND t.day > since AND t.day <= sw.day)),
dn AS (SELECT account_id, security_id, day, sum(CASE kind WHEN 'transfer_in' THEN q ELSE -q END) AS n, CASE WHEN count(*) FILTER (kind = 'transfer_out' AND NOT coalesce(price > 0, false)) = 0 THEN sum(CASE WHEN kind = 'transfer_out' THEN q * price END) / nullif(sum(CASE WHEN kind = 'transfer_out' THEN q END), 0) END AS cost FROM tx WHERE kind IN ('transfer_in', 'transfer_out') GROUP BY ALL),
pr AS (SELECT o.account_id, o.security_id, o.day AS o, i.day AS i, row_number() OVER (PARTITION BY o.account_id, o.security_id ORDER BY o.day, abs(i.day - o.day), i.day) AS k FROM dn o JOIN dn i ON o.account_id = i.account_id AND o.security_id = i.security_id AND o.n < -1e-7 AND i.n > 1e-7 AND abs(i.day - o.day) <= 10),
cn AS (SELECT account_id, security_id, 0::BIGINT AS k, list({{'d': day, 'n': n}}) AS s FROM dn GROUP BY ALL
  UNION ALL SELECT account_id, security_id, k, list_transform(s, lambda x: {{'d': x.d, 'n': CASE WHEN x.d = o THEN x.n + u WHEN x.d = i THEN x.n - u ELSE x.n END}}) FROM
    (SELECT c.account_id, c.security_id, p.k, c.s, p.o, p.i, greatest(least(list_filter(c.s, lambda x: x.d = p.i)[1].n, -(list_filter(c.s, lambda x: x.d = p.o)[1].n)), 0) AS u FROM cn c JOIN pr p ON p.account_id = c.account_id AND p.security_id = c.security_id AND p.k = c.k + 1)),
lf AS (SELECT account_id, security_id, unnest(s) AS x FROM (SELECT account_id, security_id, arg_max(s, k) AS s FROM cn GROUP BY ALL)),
bl AS (SELECT account_id, security_id, day, any_value(b) AS b, any_value(own) AS own, any_value(buys) AS buys FROM (SELECT account_id, security_id, day, sum(CASE WHEN kind IN ('buy', 'transfer_in') THEN q ELSE -q END) OVER (PARTITION BY account_id, security_id ORDER BY day) AS b, sum(CASE WHEN kind IN ('buy', 'transfer_in') THEN q ELSE -q END) OVER (PARTITION BY account_id, security_id, day) AS own, bool_or(kind = 'buy') OVER (PARTITION BY account_id, security_id, day) AS buys FROM tx) GROUP BY ALL),
ld AS (SELECT dn.security_id, dn.account_id, dn.day AS date, -x.n AS quantity, cost, abs(b) <= 1e-7 AS closed FROM lf JOIN dn ON dn.account_id = lf.account_id AND dn.security_id = lf.security_id AND dn.day = x.d JOIN bl ON bl.account_id = dn.account_id AND bl.security_id = dn.security_id AND bl.day = dn.day WHERE x.n < -1e-7)"""
#: Every departure with every account that could have its quantity, and what that account's records say.
RESOLVED = f"""{MOVES},
sure AS (SELECT security_id, account_id AS from_account, day AS date, sum(q) AS quantity, CASE WHEN account_id % 2 = 0 THEN (account_id + 1) % 5000 END AS to_account FROM tx WHERE kind = 'transfer_out' AND security_id % 25 = 0 GROUP BY ALL),
od AS (SELECT *, 'ledger' AS source FROM ld UNION ALL BY NAME SELECT *, true AS closed, 'snapshot' AS source FROM fell),
ask AS (SELECT security_id, account_id, date, quantity, cost, closed, source FROM od UNION ALL SELECT security_id, from_account, date, quantity, NULL, false, 'manual' FROM sure),
who AS (SELECT account_id, security_id FROM tx UNION SELECT account_id, security_id FROM st),
rec AS (SELECT account_id, security_id, min(day) AS first, max(day) AS last, min(CASE WHEN kind <> 'transfer_in' THEN day END) AS other, min(day) AS move FROM tx GROUP BY ALL),
sr AS (SELECT account_id, security_id, min(day) AS first, max(day) AS last, min(CASE WHEN q > 1e-7 THEN day END) AS held, list({{'d': day, 'q': q, 'c': CASE WHEN q > 1e-7 AND price > 0 THEN price END}} ORDER BY day) AS s FROM st GROUP BY ALL),
ti AS (SELECT account_id, security_id, list({{'d': day, 'q': q, 'p': price, 'r': ref}} ORDER BY day, ref) AS t FROM tx WHERE kind = 'transfer_in' GROUP BY ALL),
pp AS (SELECT a.*, w.account_id AS b, rec.first AS rf, rec.last AS rl, rec.other, sr.first AS sf, sr.last AS sl, sr.held, s, list_filter(coalesce(t, []), lambda x: x.d < a.date - 7 OR x.d BETWEEN a.date - 7 AND a.date + 30 OR x.d + 2 BETWEEN a.date - 7 AND a.date + 30) AS ins, len(list_filter(coalesce(t, []), lambda x: x.d BETWEEN a.date - 7 AND a.date + 30 OR x.d + 2 BETWEEN a.date - 7 AND a.date + 30)) AS near
  FROM ask a JOIN who w ON w.security_id = a.security_id AND w.account_id <> a.account_id LEFT JOIN rec ON rec.account_id = w.account_id AND rec.security_id = w.security_id LEFT JOIN sr ON sr.account_id = w.account_id AND sr.security_id = w.security_id LEFT JOIN ti ON ti.account_id = w.account_id AND ti.security_id = w.security_id),
p2 AS (SELECT *, coalesce(held < date - 7, false) OR coalesce(other < date - 7, false) AS early, list_filter(coalesce(s, []), lambda x: x.d >= date - 7)[1] AS sn FROM pp WHERE near > 0 OR coalesce(rl >= date - 7, false) OR coalesce(sl >= date - 7, false)),
p3 AS (SELECT p2.*, f.own AS fown, f.buys, e.b AS eb, CASE WHEN early THEN 'early' WHEN len(ins) > 0 THEN 'transfer_in' WHEN rf IS NOT NULL AND (sn IS NULL OR rf < sn.d) THEN 'trade' WHEN sn IS NOT NULL THEN 'snapshot' END AS kind FROM p2 LEFT JOIN bl f ON f.account_id = p2.b AND f.security_id = p2.security_id AND f.day = p2.rf LEFT JOIN bl e ON e.account_id = p2.b AND e.security_id = p2.security_id AND e.day = least(p2.rf, p2.sf)),
p4 AS (SELECT security_id, account_id, date, source, quantity, b, kind, CASE kind WHEN 'early' THEN CASE WHEN sf IS NOT NULL AND sf <= coalesce(rf, sf) THEN s[1].q ELSE coalesce(eb, 0) END WHEN 'transfer_in' THEN list_sum(list_transform(ins, lambda x: x.q)) WHEN 'trade' THEN fown ELSE sn.q END AS q,
  CASE kind WHEN 'transfer_in' THEN date WHEN 'snapshot' THEN sn.d END AS eff, CASE kind WHEN 'transfer_in' THEN CASE WHEN len(list_filter(ins, lambda x: NOT coalesce(x.p > 0, false))) = 0 THEN list_sum(list_transform(ins, lambda x: x.q * x.p)) / nullif(list_sum(list_transform(ins, lambda x: x.q)), 0) END WHEN 'snapshot' THEN sn.c END AS c, cost, CASE WHEN kind = 'transfer_in' THEN array_to_string(list_transform(ins, lambda x: x.r), ',') ELSE '' END AS refs FROM p3 WHERE kind IS NOT NULL),
p5 AS (SELECT security_id, account_id, date, source, list({{'b': b, 'k': kind, 'e': eff, 'm': CASE WHEN cost > 0 AND c > 0 THEN abs(c - cost) / cost <= 0.02 END, 'r': refs}}) AS cands FROM p4 WHERE abs(q - quantity) <= 1e-7 GROUP BY ALL),
sq AS (SELECT o.*, coalesce(cands, []) AS cands, row_number() OVER (PARTITION BY o.security_id ORDER BY o.date, o.account_id, o.source) AS n FROM od o LEFT JOIN p5 USING (security_id, account_id, date, source) LEFT JOIN sure m ON m.security_id = o.security_id AND m.from_account = o.account_id AND m.date = o.date WHERE m.date IS NULL),
go AS (SELECT security_id, 0::BIGINT AS n, coalesce(any_value(u), []) AS used, NULL::BIGINT AS b, NULL::BOOLEAN AS m, '' AS r, 0::BIGINT AS found FROM od LEFT JOIN (SELECT security_id, list(to_account::BIGINT) AS u FROM sure WHERE to_account IS NOT NULL GROUP BY ALL) USING (security_id) GROUP BY security_id
  UNION ALL SELECT security_id, n, CASE WHEN len(f) = 1 THEN list_append(used, f[1].b) ELSE used END, CASE WHEN len(f) = 1 THEN f[1].b END, CASE WHEN len(f) = 1 THEN f[1].m END, CASE WHEN len(f) = 1 THEN f[1].r ELSE '' END, found FROM
    (SELECT *, list_filter(p, lambda x: x.e = list_min(list_transform(p, lambda y: y.e))) AS f FROM (SELECT *, CASE WHEN len(list_filter(pool, lambda x: coalesce(x.m, false))) > 0 THEN list_filter(pool, lambda x: coalesce(x.m, false)) ELSE pool END AS p FROM
      (SELECT g.security_id, q.n, g.used, len(list_filter(q.cands, lambda x: NOT list_contains(g.used, x.b))) AS found, list_filter(q.cands, lambda x: NOT list_contains(g.used, x.b) AND x.k IN ('snapshot', 'transfer_in') AND coalesce(x.m, true) AND x.e - q.date <= 400) AS pool FROM go g JOIN sq q ON q.security_id = g.security_id AND q.n = g.n + 1)))),
res AS (SELECT q.security_id, q.account_id AS from_account, q.date, q.quantity, q.source, g.b AS to_account, CASE WHEN g.b IS NOT NULL THEN 'auto' WHEN g.found > 0 OR (q.source = 'ledger' AND q.closed) THEN 'unresolved' END AS outcome, g.m AS cost_match, g.r AS absorbed, g.found AS matches FROM sq q JOIN go g ON g.security_id = q.security_id AND g.n = q.n)
SELECT * FROM res WHERE outcome IS NOT NULL
UNION ALL SELECT o.security_id, o.account_id, o.date, o.quantity, o.source, NULL, 'dismissed', NULL, '', 0 FROM od o JOIN sure m ON m.security_id = o.security_id AND m.from_account = o.account_id AND m.date = o.date WHERE m.to_account IS NULL
UNION ALL SELECT m.security_id, m.from_account, m.date, m.quantity, 'manual', m.to_account, 'manual', NULL, coalesce(list_filter(p.cands, lambda x: x.k = 'transfer_in' AND x.b = m.to_account)[1].r, ''), 0 FROM sure m LEFT JOIN p5 p ON p.security_id = m.security_id AND p.account_id = m.from_account AND p.date = m.date AND p.source = 'manual' WHERE m.to_account IS NOT NULL"""

CHAIN = f"""pc AS (SELECT *, CASE security_id % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'JPY' END AS currency FROM prices), lk AS (SELECT * FROM pc WHERE security_id % 7 <> 3 AND security_id % 7 <> 4 AND security_id % 13 <> 5), ma AS (SELECT * REPLACE (price + 7 AS price) FROM pc WHERE (security_id % 7 = 3 OR security_id % 5 = 2) AND month(date) % 3 = 0),
dv AS (SELECT m.security_id, d::DATE AS date, m.price, m.currency FROM generate_series(DATE '1996-01-01', DATE '1996-12-31', INTERVAL 1 DAY) t(d) JOIN (SELECT *, lead(date) OVER (PARTITION BY security_id ORDER BY date) AS nd FROM ma WHERE security_id % 7 = 3) m ON d::DATE >= m.date AND (nd IS NULL OR d::DATE < nd)),
cr AS (SELECT security_id, date, price, currency, 'linked' AS source, 1 AS k FROM lk UNION ALL SELECT security_id, date, price, currency, 'manual', 0 FROM ma WHERE security_id IN (SELECT security_id FROM lk) UNION ALL SELECT security_id, date, price, currency, 'derived', 1 FROM dv WHERE security_id NOT IN (SELECT security_id FROM lk)
  UNION ALL SELECT security_id, date, price * 2, 'JPY', 'reported', 1 FROM pc WHERE security_id % 13 <> 5 AND day(date) <> 31 AND security_id NOT IN (SELECT security_id FROM lk UNION SELECT security_id FROM ma)),
ch_ AS (SELECT security_id, date, arg_min(price, k)::DOUBLE AS price, arg_min(source, k) AS source FROM cr GROUP BY ALL), cc AS (SELECT security_id, arg_max(currency, (k, date)) AS price_currency FROM cr GROUP BY 1), chain AS (SELECT ch_.*, price_currency FROM ch_ JOIN cc USING (security_id))"""
# every security without a linked series, on all days from its first appraisal to the last of all prices
WHOLE_CHAIN = CHAIN.replace(CHAIN[CHAIN.index("\ndv AS ("):CHAIN.index("\ncr AS (")], """
dv AS (SELECT security_id, unnest(generate_series(date, coalesce(nd - 1, until), INTERVAL 1 DAY))::DATE AS date, price, currency FROM (SELECT *, lead(date) OVER (PARTITION BY security_id ORDER BY date) AS nd, (SELECT max(date) FROM pc) AS until FROM ma WHERE security_id NOT IN (SELECT security_id FROM lk))),""").replace("security_id % 13 <> 5 AND day(date) <> 31 AND security_id NOT IN", "security_id NOT IN")
LOT_PATHS = PATHS.replace(PATHS[PATHS.index("\nst AS ("):PATHS.index("\nmv AS (")], f"""
st AS (SELECT {G}, 0 AS lot_seq, as_of_date, {LOT_QUANTITY} AS quantity, {LOT_COST} AS avg_cost, {LOT_REPORTED} AS reported FROM snap WHERE NOT {CLOSED} AND as_of_date >= {LOT_FROM}),""")


def worths(before: str, closed: str, override: str) -> str:
    """Lots on every day, with their worth: what statements say, else what paths do."""
    return f"""{before}, {PRICES}, {RATES}, {INS}, {CHAIN}, dd AS (SELECT unnest(generate_series(DATE '{FROM}', DATE '{TO}', INTERVAL 1 DAY))::DATE AS day),
f1 AS (SELECT {G}, arg_min(quantity, as_of_date)::DOUBLE AS q, arg_min({{'c': avg_cost}}, as_of_date).c AS c, arg_min({{'r': reported}}, as_of_date).r AS rp, min(as_of_date) AS first FROM st GROUP BY ALL),
g1 AS (SELECT f1.account_id, f1.security_id, dd.day, s.quantity::DOUBLE AS q, s.avg_cost, s.reported, f1.q AS fq, f1.c AS fc, f1.rp AS frp, s.as_of_date IS NULL AS early FROM f1 CROSS JOIN dd ASOF LEFT JOIN st s ON s.account_id = f1.account_id AND s.security_id = f1.security_id AND dd.day >= s.as_of_date),
g2 AS (SELECT g1.*, x.status FROM g1 JOIN sx x USING ({G})),
g3 AS (SELECT {G}, day, CASE WHEN early THEN fq ELSE q END AS quantity, CASE WHEN early THEN fc ELSE avg_cost END AS avg_cost, CASE WHEN early THEN frp ELSE reported END AS reported, early AS backfilled FROM g2 WHERE NOT (early AND status = 'traced')),
g4 AS (SELECT x.account_id, x.security_id, dd.day, coalesce(c.quantity, x.opening) AS quantity, c.day IS NULL AND x.opening > 1e-7 AS est, x.status FROM sx x JOIN dd ON (x.first IS NULL OR dd.day < x.first) ASOF LEFT JOIN ch c ON c.account_id = x.account_id AND c.security_id = x.security_id AND dd.day >= c.day WHERE x.status IN ('traced'{closed})),
g5 AS (SELECT account_id, security_id, day, quantity, avg_cost, reported, backfilled FROM g3 WHERE quantity <> 0 UNION ALL SELECT g4.account_id, g4.security_id, day, quantity, CASE WHEN f1.q <> 0 THEN f1.c END, CASE WHEN f1.q <> 0 THEN f1.rp * quantity / f1.q END, est FROM g4 LEFT JOIN f1 USING ({G}) WHERE quantity <> 0),
pf AS (SELECT security_id, min(date) AS d0, arg_min(price, date) AS p0 FROM chain GROUP BY 1), pd AS (SELECT pf.security_id, dd.day, coalesce(c.price, p0) AS price FROM pf CROSS JOIN dd ASOF LEFT JOIN chain c ON c.security_id = pf.security_id AND dd.day >= c.date),
rf AS (SELECT currency, arg_min(rate, date) AS r0 FROM rates GROUP BY 1), rd AS (SELECT rf.currency, dd.day, coalesce(x.rate, r0) AS rate FROM rf CROSS JOIN dd ASOF LEFT JOIN rates x ON x.currency = rf.currency AND dd.day >= x.date),
wa AS (SELECT g5.*, i.asset_class, i.divisor, i.linked, pd.price, CASE WHEN i.currency = 'JPY' THEN 1 ELSE ro.rate END AS ro, CASE WHEN cc.price_currency = 'JPY' THEN 1 ELSE ra.rate END AS ra, {override} AS override FROM g5 JOIN ins i ON i.security_id = g5.security_id LEFT JOIN pd ON pd.security_id = g5.security_id AND pd.day = g5.day LEFT JOIN cc ON cc.security_id = g5.security_id
  LEFT JOIN rd ro ON ro.currency = i.currency AND ro.day = g5.day LEFT JOIN rd ra ON ra.currency = cc.price_currency AND ra.day = g5.day {"LEFT JOIN ov ON ov.account_id = g5.account_id AND ov.security_id = g5.security_id" if override != "NULL" else ""}),
wb AS (SELECT *, CASE WHEN asset_class = 'cash' THEN coalesce(quantity * ro, reported, 0) ELSE coalesce(CASE WHEN NOT (asset_class = 'pension' AND linked AND quantity <= 1) THEN quantity * price / divisor * ra END, reported, CASE WHEN asset_class = 'point' THEN quantity END, 0) END AS value,
  CASE WHEN asset_class <> 'cash' THEN CASE WHEN asset_class = 'pension' THEN coalesce(override, avg_cost) ELSE quantity * coalesce(override, avg_cost) / divisor * ro END END AS cost FROM wa)"""


#: The replay's and the paths' expressions in one statement.
BOTH = REPLAY.rstrip() + ", ov AS (SELECT account_id, security_id, av AS ov FROM av WHERE cov = 'full' AND av IS NOT NULL AND coalesce(lots, 1) = 1)" + LOT_PATHS[LOT_PATHS.index("\nst AS (") - 1:]
TEXT = "regexp_replace(lower(name), '\\s+', '', 'g')"
RULE = lambda what: "CASE " + " ".join(f"WHEN upper(trim(code)) = '{c}' THEN {dict(rule=chr(39) + r_ + chr(39), by=chr(39) + 'code' + chr(39), value='upper(trim(code))')[what]}" for c, r_ in CODES.items() if r_ in {x.name for x in RULES}) + " " + " ".join(
    f"WHEN {' AND '.join([*(f'NOT contains(t, {chr(39)}{e}{chr(39)})' for e in x.excludes), *([f'asset_class IN ({chr(44).join(chr(39) + c + chr(39) for c in x.classes)})'] if x.classes else []), *(['(' + ' OR '.join(f'contains(t, {chr(39)}{k}{chr(39)})' for k in x.keywords) + ')'] if x.keywords else [])])} THEN "
    + {"rule": f"'{x.name}'", "by": "'keyword'" if x.keywords else "'class'", "value": ("CASE " + " ".join(f"WHEN contains(t, '{k}') THEN '{k}'" for k in x.keywords) + " END") if x.keywords else "asset_class"}[what] for x in RULES) + " END"

SQL: dict[str, str] = {
    "lot_totals": f"""{PATHS.replace('WITH RECURSIVE', 'WITH', 1)[:PATHS.replace('WITH RECURSIVE', 'WITH', 1).index(chr(10) + 'mv AS (')].rstrip(',')}, c AS (SELECT *, CASE WHEN (security_id + lot_seq + month(as_of_date)) % 5 <> 0 THEN (100 + security_id + lot_seq * 50)::DOUBLE END AS avg_cost FROM st),
dt AS (SELECT DISTINCT {G}, as_of_date AS date FROM st), lt AS (SELECT DISTINCT {G}, lot_seq FROM st), x AS (SELECT dt.account_id, dt.security_id, date, c.quantity AS q, c.avg_cost AS a FROM dt JOIN lt USING ({G}) ASOF JOIN c ON c.account_id = dt.account_id AND c.security_id = dt.security_id AND c.lot_seq = lt.lot_seq AND dt.date >= c.as_of_date)
SELECT {G}, date, sum(q)::DOUBLE AS total, {r("CASE WHEN count(*) FILTER (q > 1e-7 AND a IS NULL) = 0 THEN sum(CASE WHEN q > 1e-7 THEN q * a END) / nullif(sum(CASE WHEN q > 1e-7 THEN q END), 0) END")} AS cost FROM x GROUP BY {G}, date""",
    "previous_day_basis": f"""{PATHS.replace('WITH RECURSIVE', 'WITH', 1)[:PATHS.replace('WITH RECURSIVE', 'WITH', 1).index(chr(10) + 'mv AS (')].rstrip(',')}, l AS (SELECT account_id, max(as_of_date + (account_id % 5)::INTEGER) FILTER (as_of_date + (account_id % 5)::INTEGER <= {DAY} + 3) AS last FROM st GROUP BY 1)
SELECT account_id, greatest(least(last, {DAY}), {DAY} - 1) - 1 AS basis FROM l WHERE last IS NOT NULL""",
    "price_chain": f"WITH {RICH}, {PRICES}, {WHOLE_CHAIN} SELECT security_id, date, {r('price', 2)} AS price, price_currency, source FROM chain",
    "history_by_class": f"{worths(BOTH, '', 'ov.ov')} SELECT asset_class, day, {r(f'sum(value) * {SURE}::DOUBLE', 0)} AS value, {r(f'sum(cost) * {SURE}::DOUBLE', 0)} AS cost FROM wb GROUP BY ALL",
    "history_by_security": f"{worths(LOT_PATHS, chr(44) + chr(39) + 'closed' + chr(39), 'NULL')} SELECT wb.security_id, wb.day, {r(f'sum(value) / any_value(rd.rate) * {SURE}::DOUBLE', 1)} AS value, {r(f'sum(cost) / any_value(rd.rate) * {SURE}::DOUBLE', 1)} AS cost, {r('sum(quantity)')} AS quantity, bool_or(backfilled) AS backfilled FROM wb JOIN rd ON rd.currency = 'USD' AND rd.day = wb.day GROUP BY wb.security_id, wb.day",
    "trade_price_fill": f"WITH {RICH}, {PRICES}, {CHAIN} SELECT concat_ws('-', {REF}, t.security_id, t.quantity) AS ref, {r('arg_max(c.price, c.date)', 2)} AS price, max(c.date) AS priced_on FROM rich t LEFT JOIN chain c ON c.security_id = t.security_id AND c.price_currency = t.currency AND c.date BETWEEN t.trade_date - 7 AND t.trade_date WHERE unit_price IS NULL GROUP BY ALL",
    "coin_day_changes": f"""WITH d AS (SELECT user_id, ts::DATE AS t, sum(floor(value * 100)::BIGINT) AS v FROM events GROUP BY ALL), l AS (SELECT user_id, arg_max(v, t)::DOUBLE AS v FROM d GROUP BY 1), o AS (SELECT user_id, arg_max(v, t)::DOUBLE AS own, max(t) AS seen FROM d WHERE t < DATE '2024-01-30' GROUP BY 1)
SELECT 'C' || l.user_id AS symbol, v AS value, coalesce(CASE WHEN l.user_id % 3 = 0 THEN v - l.user_id END, CASE WHEN DATE '2024-01-30' - seen <= 7 THEN own END) AS previous, v - previous AS day_change, {r('CASE WHEN l.user_id % 3 = 0 THEN l.user_id * 100 / nullif(v - l.user_id, 0) END')} AS reported_pct, CASE WHEN l.user_id % 3 = 0 THEN '2024-01-29' END AS as_of
FROM l LEFT JOIN o USING (user_id) WHERE l.user_id % 17 <> 0 AND l.user_id % 19 <> 0 AND l.user_id % 11 <> 0""",
    "classes_with_coins": f"""WITH {RICH}, {PRICES}, {RATES}, {INS}, {LOTS}, e AS (SELECT user_id, sum(floor(value * 100)::BIGINT)::DOUBLE AS v FROM events GROUP BY 1),
c AS (SELECT asset_class, sum(value) AS value, sum(before) AS prev_value, sum(value) - sum(before) AS day_change, false AS partial, count(*) AS holdings, asset_class <> 'point' AS in_total FROM lots GROUP BY 1 UNION ALL SELECT 'crypto', sum(v), sum(CASE WHEN user_id % 3 <> 0 THEN v - user_id END), sum(CASE WHEN user_id % 3 <> 0 THEN user_id END), true, count(*), true FROM e)
SELECT asset_class, {r('value', 2)} AS value, {r('prev_value', 2)} AS prev_value, {r('day_change', 2)} AS day_change, partial, holdings, in_total, {r('CASE WHEN in_total THEN value * 100 / (SELECT sum(value) FROM c WHERE in_total) END', 5)} AS weight FROM c""",
    "rule_suggestions": f"""WITH p AS (SELECT p_partkey AS security_id, {', '.join(f"{x.replace('STRING', 'VARCHAR')} AS {k}" for k, x in PART.items())} FROM part), q AS (SELECT *, {TEXT} AS t FROM p), m AS (SELECT *, {RULE('rule')} AS rule, {RULE('by')} AS matched_by, {RULE('value')} AS matched_value FROM q),
s AS (SELECT *, CASE rule WHEN 'metal' THEN '1:100' WHEN 'large' THEN '2:60' WHEN 'tin' THEN '1:50,2:50' WHEN 'fund' THEN '3:100' WHEN 'guess' THEN '2:100' END AS suggested, CASE WHEN security_id % 3 = 0 THEN NULL WHEN security_id % 6 = 1 THEN '1:50,2:50' ELSE (security_id % 3)::VARCHAR || ':100' END AS now FROM m)
SELECT security_id, rule, matched_by, matched_value, coalesce(rule = 'guess' AND matched_by = 'class' AND contains(t, 'etf'), false) AS doubtful, CASE WHEN rule IS NULL THEN 'no-rule' WHEN rule = 'large' THEN 'missing-tag' WHEN now IS NULL THEN 'new' WHEN now = suggested THEN 'unchanged' ELSE 'change' END AS status, suggested, CASE WHEN rule = 'large' THEN 'lost' WHEN rule IS NOT NULL THEN '' END AS missing FROM s""",
    "cost_override": f"""{REPLAY}, {PRICES}, {RATES}, {INS}, {LOTS}, ov AS (SELECT {G}, av AS ov FROM av WHERE cov = 'full' AND av IS NOT NULL AND coalesce(lots, 1) = 1)
SELECT account_id, security_id, ov IS NOT NULL AS overridden, {r(cost('coalesce(ov, avg_cost)'), 2)} AS lot_cost FROM lots LEFT JOIN ov USING ({G})""",
    "ledger_departures": f"{MOVES} SELECT security_id, account_id, date, quantity, {r('cost', 2)} AS cost, closed FROM ld",
    "snapshot_outflows": f"{MOVES} SELECT * FROM fell",
    "transfer_resolution": RESOLVED,
    "quantity_paths": f"""{PATHS} SELECT {G}, status, first AS before, {r("CASE WHEN status IN ('traced', 'closed') THEN opening END")} AS opening, day, {r('quantity')} AS quantity FROM sx LEFT JOIN ch USING ({G})""",
    "path_days": f"""{PATHS}, dy AS (SELECT unnest(generate_series(DATE '1996-01-01', DATE '1996-03-31', INTERVAL 1 DAY))::DATE AS day),
onday AS (SELECT sx.account_id, sx.security_id, dy.day, c.quantity AS q, opening FROM sx JOIN dy ON (first IS NULL OR dy.day < first) ASOF LEFT JOIN ch c ON c.account_id = sx.account_id AND c.security_id = sx.security_id AND dy.day >= c.day WHERE status IN ('traced', 'closed'))
SELECT security_id, day, {r('sum(coalesce(q, opening))', 2)} AS quantity, {r('sum(CASE WHEN q IS NULL AND opening > 1e-7 THEN opening ELSE 0 END)', 2)} AS estimated, count(*) AS positions FROM onday GROUP BY security_id, day""",
    "position_replay": f"""{REPLAY} SELECT {G}, cov AS coverage, closed, {r('q0')} AS opening_quantity, {r("CASE WHEN cov = 'partial' THEN c0 END", 2)} AS opening_cost, {r('rest')} AS residual_quantity, {r('held - rest')} AS covered_quantity, {r('av', 2)} AS avg_cost,
  {r('CASE WHEN sales > 0 THEN realized END', 2)} AS realized, {r('CASE WHEN sales > 0 THEN sold END', 2)} AS cost_sold, {r('CASE WHEN NOT fremd THEN income END', 0)} AS income, {r('CASE WHEN NOT fremd THEN withheld END', 0)} AS withheld, CASE WHEN NOT fremd THEN tx_count END AS tx_count,
  CASE WHEN NOT fremd THEN first_trade END AS first_trade, CASE WHEN NOT fremd THEN last_trade END AS last_trade, CASE WHEN rest IS NOT NULL THEN CASE WHEN cov = 'full' AND first_buy IS NOT NULL THEN first_buy ELSE coalesce(held_since, first_buy) END END AS acquired_on,
  cov = 'full' AND av IS NOT NULL AND coalesce(lots, 1) = 1 AS applies, coalesce(bad, false) AS irregular, stops::BIGINT AS roc_stops, costless::BIGINT AS costless_transfers FROM av""",
}
