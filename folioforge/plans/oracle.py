"""DuckDB SQL for the portfolio queries."""

from __future__ import annotations

LEDGER = """ledger AS (SELECT c_nationkey::BIGINT AS account_id, l_suppkey AS security_id, o_orderdate::DATE AS trade_date, l_shipdate::DATE AS settle_date,
  CASE l_returnflag WHEN 'N' THEN 'buy' WHEN 'A' THEN 'reinvest' ELSE 'sell' END AS tx_type, l_quantity::BIGINT AS quantity,
  floor(l_extendedprice * 100 + 0.5)::BIGINT AS gross, floor(l_extendedprice * l_discount * 100 + 0.5)::BIGINT AS fee, floor(l_extendedprice * l_tax * 100 + 0.5)::BIGINT AS tax,
  l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, CASE l_returnflag WHEN 'R' THEN -(l_quantity::BIGINT) ELSE l_quantity::BIGINT END AS sq
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
SNAP = """snap AS (SELECT account_id, security_id, as_of_date, (1000 + sum(dq) OVER w)::BIGINT AS quantity, (sum(dc) OVER w)::BIGINT AS cost, (sum(db) OVER w)::BIGINT AS bought
  FROM (SELECT account_id, security_id, last_day(trade_date) AS as_of_date, sum(sq) AS dq, sum(CASE WHEN tx_type <> 'sell' THEN gross ELSE 0 END) AS dc,
    sum(CASE WHEN tx_type <> 'sell' THEN quantity ELSE 0 END) AS db FROM ledger GROUP BY ALL)
  WINDOW w AS (PARTITION BY account_id, security_id ORDER BY as_of_date))"""
PRICES = "prices AS (SELECT security_id, last_day(trade_date) AS date, (sum(gross) // sum(quantity))::BIGINT AS price FROM ledger GROUP BY ALL)"
CLOSES = "closes AS (SELECT event_type, ts::DATE AS date, arg_max(value, (ts, event_id)) AS price FROM events GROUP BY ALL)"
SEC = "sec AS (SELECT s_suppkey AS security_id, s_name AS name, n_name AS asset_class, n_regionkey::BIGINT AS region_id FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
LOTS = """cur AS (SELECT account_id, security_id, arg_max(quantity, as_of_date) AS quantity, arg_max(cost, as_of_date) AS cost, arg_max(bought, as_of_date) AS bought FROM snap WHERE as_of_date <= DATE '1998-06-30' GROUP BY ALL),
old AS (SELECT account_id, security_id, arg_max(quantity, as_of_date) AS prev_quantity FROM snap WHERE as_of_date <= DATE '1998-05-31' GROUP BY ALL),
p1 AS (SELECT security_id, arg_max(price, date) AS price FROM prices WHERE date <= DATE '1998-06-30' GROUP BY ALL),
p0 AS (SELECT security_id, arg_max(price, date) AS prev_price FROM prices WHERE date <= DATE '1998-05-31' GROUP BY ALL),
lots AS (SELECT *, value - lot_cost AS pl, value - prev_value AS day_change FROM (SELECT *, quantity * price AS value, CASE WHEN bought > 0 THEN (quantity * cost) // bought END AS lot_cost,
  CASE WHEN price IS NOT NULL THEN coalesce(prev_quantity, quantity) * prev_price END AS prev_value
  FROM cur LEFT JOIN old USING (account_id, security_id) LEFT JOIN p1 USING (security_id) LEFT JOIN p0 USING (security_id)
  WHERE NOT (quantity = 0 AND coalesce(prev_quantity, quantity) = 0)))"""
BASE = f"WITH {LEDGER}, {SNAP}, {PRICES}"
VALUED = f"{BASE}, {LOTS}, {SEC}"
DAYS = "days AS (SELECT unnest(generate_series(DATE '1998-01-01', DATE '1998-01-31', INTERVAL 1 DAY))::DATE AS day)"


def r(x: str, digits: int = 4) -> str:
    return f"(floor(({x})::DOUBLE * 1e{digits} + 0.5) / 1e{digits})"


def ratio(a: str, b: str, digits: int = 4) -> str:
    return r(f"({a})::DOUBLE / nullif(({b})::DOUBLE, 0)", digits)


def rolled(key: str, source: str) -> str:
    return f"""{VALUED}, g AS (SELECT {key}, sum(value)::BIGINT AS value, sum(CASE WHEN value IS NOT NULL THEN lot_cost END)::BIGINT AS cost, sum(pl)::BIGINT AS pl, sum(day_change)::BIGINT AS day_change,
  bool_or(value IS NOT NULL AND day_change IS NULL) AS day_change_partial, count(*) AS lots, count(DISTINCT security_id) AS holdings FROM {source} GROUP BY {key})
SELECT *, {ratio("value", "(SELECT sum(value) FROM g)")} AS weight, {ratio("pl * 100", "cost", 2)} AS pl_pct FROM g"""


def asof_price(backfill: bool) -> str:
    first = ", (SELECT arg_min(price, date) FROM prices p WHERE p.security_id = l.security_id)" if backfill else ""
    return f"""{BASE} SELECT security_id, count(*) AS lookups, count(price) AS found, sum(price)::BIGINT AS price_sum FROM (
  SELECT l.security_id, coalesce(p.price{first}) AS price FROM ledger l ASOF LEFT JOIN prices p ON l.security_id = p.security_id AND l.trade_date >= p.date) GROUP BY ALL"""


POOL = f"""WITH RECURSIVE {LEDGER}, seq AS (SELECT *, row_number() OVER (PARTITION BY account_id, security_id ORDER BY trade_date, l_orderkey, l_linenumber, l_partkey) AS n FROM ledger),
run AS (SELECT account_id, security_id, 0::BIGINT AS n, 1000::BIGINT AS balance, 100000000.0::DOUBLE AS pool, NULL::DOUBLE AS realized FROM (SELECT DISTINCT account_id, security_id FROM ledger)
  UNION ALL SELECT s.account_id, s.security_id, s.n, r.balance + s.sq, CASE WHEN s.tx_type = 'sell' THEN r.pool * ((r.balance + s.sq)::DOUBLE / r.balance) ELSE r.pool + s.gross + s.fee END,
    CASE WHEN s.tx_type = 'sell' THEN s.gross - s.fee - r.pool * s.quantity / r.balance END
  FROM run r JOIN seq s ON s.account_id = r.account_id AND s.security_id = r.security_id AND s.n = r.n + 1)"""
INDEX = f"""{CLOSES}, pts AS (SELECT event_type, date, price, lead(date) OVER w AS nd, lead(price) OVER w AS np FROM closes WHERE day(date) IN (3, 10, 17, 24) AND price > 0 WINDOW w AS (PARTITION BY event_type ORDER BY date)),
idx AS (SELECT event_type, d::DATE AS day, {r("CASE WHEN nd IS NULL THEN price ELSE price + (np - price) * (date_diff('day', date, d::DATE)::DOUBLE / date_diff('day', date, nd)) END")} AS level
  FROM (SELECT *, unnest(generate_series(date, greatest(date, coalesce(nd - 1, DATE '2024-01-30')), INTERVAL 1 DAY)) AS d FROM pts))"""
WEIGHTS = f"""{VALUED}, w AS (SELECT security_id, security_id % 4 + 1 AS tag_id, security_id % 7 * 10 + 20 AS weight FROM sec UNION ALL SELECT security_id, 5, 15 FROM sec WHERE security_id % 3 = 0),
h AS (SELECT security_id, coalesce(sum(value), 0) AS value FROM lots GROUP BY ALL), used AS (SELECT security_id, sum(least(weight, 100)) AS used FROM w GROUP BY ALL),
shares AS (SELECT h.security_id, value, tag_id, least(weight, 100) AS weight, value * least(weight, 100) / 100.0::DOUBLE AS part FROM h JOIN w USING (security_id)
  UNION ALL SELECT h.security_id, value, 0, greatest(100 - coalesce(used, 0), 0), value * greatest(100 - coalesce(used, 0), 0) / 100.0::DOUBLE FROM h LEFT JOIN used USING (security_id) WHERE coalesce(used, 0) < 100)"""
RANGES = f"""WITH {LEDGER}, r0 AS (SELECT security_id, trade_date AS s, (trade_date + (quantity % 9)::INT)::DATE AS e FROM ledger),
r1 AS (SELECT *, max(e) OVER (PARTITION BY security_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r0),
r2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR reach + 1 < s THEN 1 ELSE 0 END) OVER (PARTITION BY security_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM r1),
merged AS (SELECT security_id, min(s) AS start_date, max(e) AS end_date FROM r2 GROUP BY security_id, island)"""
REFS = "refs AS (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, security_id) AS ref FROM ledger)"
OCC = f"WITH {LEDGER}, occ AS (SELECT *, row_number() OVER (PARTITION BY account_id, security_id, trade_date, tx_type, quantity ORDER BY trade_date, l_orderkey, l_linenumber, l_partkey) - 1 AS occurrence FROM ledger)"
ON_DAYS = f"""{BASE}, {DAYS}, {SEC}, s AS (SELECT *, lead(as_of_date) OVER (PARTITION BY account_id, security_id ORDER BY as_of_date) AS nxt, row_number() OVER (PARTITION BY account_id, security_id ORDER BY as_of_date) AS rn FROM snap),
p AS (SELECT *, lead(date) OVER (PARTITION BY security_id ORDER BY date) AS nxt, row_number() OVER (PARTITION BY security_id ORDER BY date) AS rn FROM prices),
j AS (SELECT day, s.security_id, s.quantity * p.price AS value, day < s.as_of_date AS backfilled FROM days JOIN s ON (day >= s.as_of_date OR s.rn = 1) AND (s.nxt IS NULL OR day < s.nxt)
  JOIN p ON p.security_id = s.security_id AND (day >= p.date OR p.rn = 1) AND (p.nxt IS NULL OR day < p.nxt))"""
KEY = r"regexp_replace(lower(regexp_replace({}, '\s*\([0-9]+\)\s*$', '')), '[\s·・]+', '', 'g')"

ROLE_COLUMNS = {"l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice", "unit": "l_extendedprice / l_quantity", "l_discount": "l_discount", "per_lot": "l_extendedprice / l_quantity * 10000"}
ROLES = "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{q}' AS quantity, '{p}' AS price, '{a}' AS amount, {d}::BIGINT AS divisor, count(*) AS checked, sum((abs(({ROLE_COLUMNS[q]}) * ({ROLE_COLUMNS[p]}) / {d}::DOUBLE - ({ROLE_COLUMNS[a]})) <= 0.005::DOUBLE * greatest(abs({ROLE_COLUMNS[a]}), 1.0::DOUBLE))::INT)::BIGINT AS passed FROM lineitem"
    for i, q in enumerate(ROLE_COLUMNS) for j, p in enumerate(ROLE_COLUMNS) if i < j for a in ROLE_COLUMNS if a not in (p, q) for d in (1, 10_000)
) + ") WHERE passed > 0.9 * checked"

SQL: dict[str, str] = {
    "latest_lot": f"{BASE} SELECT account_id, security_id, max(as_of_date) AS as_of_date, arg_max(quantity, as_of_date) AS quantity, arg_max(cost, as_of_date) AS cost, arg_max(bought, as_of_date) AS bought FROM snap GROUP BY ALL",
    "holdings_as_of": f"{BASE} SELECT account_id, security_id, max(as_of_date) AS as_of_date, arg_max(quantity, as_of_date) AS quantity, arg_max(cost, as_of_date) AS cost, arg_max(bought, as_of_date) AS bought FROM snap WHERE as_of_date <= DATE '1998-06-30' GROUP BY account_id, security_id",
    "asof_price_strict": asof_price(False),
    "asof_price_backfill": asof_price(True),
    "price_before": f"{BASE} SELECT security_id, max(date) AS date, arg_max(price, date) AS price FROM prices WHERE date < DATE '1998-06-30' GROUP BY security_id",
    "prev_close_7d": f"WITH {CLOSES} SELECT c.event_type, c.date, c.price AS close, CASE WHEN c.date - p.date <= 7 THEN p.price END AS prev_close, CASE WHEN c.date - p.date <= 7 THEN p.date END AS prev_date FROM closes c ASOF LEFT JOIN closes p ON c.event_type = p.event_type AND c.date > p.date",
    "daily_close_last_tick": f"WITH {CLOSES} SELECT * FROM closes",
    "holding_value": f"{VALUED} SELECT account_id, security_id, quantity, price, value FROM lots",
    "holding_pl": f"{VALUED} SELECT account_id, security_id, lot_cost::BIGINT AS lot_cost, pl::BIGINT AS pl, {ratio('pl * 100', 'lot_cost', 2)} AS pl_pct FROM lots",
    "day_change": f"{VALUED} SELECT account_id, security_id, prev_value, day_change FROM lots",
    "class_summary": rolled("asset_class", "lots JOIN sec USING (security_id)"),
    "account_summary": rolled("account_id", "lots"),
    "by_security_merge": f"""{VALUED} SELECT security_id, sum(quantity)::BIGINT AS quantity, sum(value)::BIGINT AS value, sum(lot_cost)::BIGINT AS cost, CASE WHEN count(value) = count(day_change) THEN sum(day_change)::BIGINT END AS day_change,
      {ratio("sum(lot_cost)", "sum(CASE WHEN lot_cost IS NOT NULL THEN quantity END)")} AS avg_cost, count(*) AS accounts, arg_max(account_id, (value, account_id)) AS largest_account FROM lots GROUP BY security_id""",
    "totals_block": f"{VALUED} SELECT sum(value)::BIGINT AS value, sum(lot_cost)::BIGINT AS cost, sum(pl)::BIGINT AS pl, sum(day_change)::BIGINT AS day_change, count(*) AS lots, bool_or(day_change IS NULL) AS day_change_partial FROM lots",
    "top_holdings_nulls_last": f"{VALUED} SELECT account_id, security_id, value FROM lots ORDER BY value DESC NULLS LAST, account_id, security_id LIMIT 20",
    "others_bucket": f"""{VALUED}, g AS (SELECT asset_class, sum(value) AS value FROM lots JOIN sec USING (security_id) GROUP BY ALL), s AS (SELECT *, coalesce(value::DOUBLE / sum(value) OVER () < 0.05, false) AS small FROM g),
      f AS (SELECT *, small AND sum(small::INT) OVER () >= 2 AS fold FROM s) SELECT CASE WHEN fold THEN 'others' ELSE asset_class END AS asset_class, sum(value)::BIGINT AS value, count(*) AS parts FROM f GROUP BY 1""",
    "daily_position_value": f"{ON_DAYS} SELECT day, sum(value)::BIGINT AS value, sum(backfilled::INT)::BIGINT AS backfilled FROM j GROUP BY day",
    "daily_series_by_class": f"{ON_DAYS} SELECT asset_class, day, sum(value)::BIGINT AS value FROM j JOIN sec USING (security_id) GROUP BY ALL",
    "ffill_gaps": f"""WITH {CLOSES}, k AS (SELECT * FROM closes WHERE day(date) % 3 <> 0), b AS (SELECT event_type, min(date) AS lo, max(date) AS hi FROM k GROUP BY event_type), d AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS date FROM b)
      SELECT d.event_type, d.date, k.price, d.date > k.date AS filled FROM d ASOF JOIN k ON d.event_type = k.event_type AND d.date >= k.date""",
    "metal_compose": f"""WITH {CLOSES}, f AS (SELECT * FROM closes WHERE event_type = 'purchase'), x AS (SELECT * FROM closes WHERE event_type = 'view' AND day(date) % 2 = 1)
      SELECT f.date, {r("f.price * x.price / 31.1034768::DOUBLE", 6)} AS gram_price FROM f ASOF JOIN x ON f.date >= x.date""",
    "index_interpolate": f"WITH {INDEX} SELECT event_type, day, level FROM idx WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-01-30'",
    "chain_link": f"""WITH {INDEX}, a AS (SELECT event_type, date, floor(price * 1000)::BIGINT AS value, lead(date) OVER w AS nd, lead(floor(price * 1000)::BIGINT) OVER w AS nv FROM closes WHERE day(date) IN (1, 12, 28) WINDOW w AS (PARTITION BY event_type ORDER BY date)),
      b AS (SELECT a.*, i0.level AS l0, i1.level AS l1, unnest(generate_series(date, nd - 1, INTERVAL 1 DAY))::DATE AS day FROM a LEFT JOIN idx i0 ON i0.event_type = a.event_type AND i0.day = a.date LEFT JOIN idx i1 ON i1.event_type = a.event_type AND i1.day = a.nd WHERE nd IS NOT NULL),
      c AS (SELECT b.*, idx.level AS l, date_diff('day', date, b.day)::DOUBLE / date_diff('day', date, nd) AS share FROM b LEFT JOIN idx ON idx.event_type = b.event_type AND idx.day = b.day)
      SELECT event_type, day, {r("CASE WHEN l0 IS NOT NULL AND l1 IS NOT NULL AND l IS NOT NULL THEN value * l / l0 + (nv - value * l1 / l0) * share ELSE value + (nv - value) * share END", 2)} AS value, l0 IS NOT NULL AND l1 IS NOT NULL AND l IS NOT NULL AS indexed FROM c""",
    "merge_ranges": f"{RANGES} SELECT * FROM merged",
    "missing_ranges": f"""{RANGES}, m AS (SELECT * FROM merged WHERE end_date >= DATE '1996-01-01' AND start_date <= DATE '1999-12-31'),
      g AS (SELECT security_id, coalesce(lag(end_date) OVER (PARTITION BY security_id ORDER BY start_date) + 1, DATE '1996-01-01') AS gap_start, start_date - 1 AS gap_end FROM m UNION ALL SELECT security_id, max(end_date) + 1, DATE '1999-12-31' FROM m GROUP BY security_id)
      SELECT security_id, gap_start::DATE AS gap_start, gap_end::DATE AS gap_end FROM g WHERE gap_start <= gap_end""",
    "ledger_page": f"WITH {LEDGER} SELECT trade_date, l_orderkey, l_linenumber, l_partkey, security_id, quantity, gross FROM ledger WHERE account_id = 3 AND tx_type = 'buy' ORDER BY trade_date DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC LIMIT 50 OFFSET 50",
    "running_balance": f"WITH {LEDGER}, d AS (SELECT account_id, security_id, trade_date, sum(sq)::BIGINT AS change, count(*) AS trades FROM ledger GROUP BY ALL) SELECT *, (1000 + sum(change) OVER (PARTITION BY account_id, security_id ORDER BY trade_date))::BIGINT AS balance FROM d",
    "moving_avg_cost": f"{POOL}, e AS (SELECT account_id, security_id, arg_max(balance, n) AS balance, arg_max(pool, n) AS pool FROM run GROUP BY ALL) SELECT account_id, security_id, balance, {r('pool', 0)} AS pool, {r('pool / nullif(balance::DOUBLE, 0)', 2)} AS avg_cost FROM e",
    "realized_pl": f"{POOL} SELECT account_id, security_id, count(*) AS sales, {r('sum(realized)', 0)} AS realized FROM run WHERE realized IS NOT NULL GROUP BY ALL",
    "coverage_flags": f"""WITH RECURSIVE {LEDGER}, seq AS (SELECT *, row_number() OVER (PARTITION BY account_id, security_id ORDER BY trade_date, l_orderkey, l_linenumber, l_partkey) AS n FROM ledger),
      run AS (SELECT account_id, security_id, 0::BIGINT AS n, 1000::BIGINT AS balance, 0.0::DOUBLE AS a, 1.0::DOUBLE AS b FROM (SELECT DISTINCT account_id, security_id FROM ledger)
        UNION ALL SELECT s.account_id, s.security_id, s.n, r.balance + s.sq, CASE WHEN s.tx_type = 'sell' THEN r.a * ((r.balance + s.sq)::DOUBLE / r.balance) ELSE r.a + s.gross + s.fee END, CASE WHEN s.tx_type = 'sell' THEN r.b * ((r.balance + s.sq)::DOUBLE / r.balance) ELSE r.b END
        FROM run r JOIN seq s ON s.account_id = r.account_id AND s.security_id = r.security_id AND s.n = r.n + 1),
      e AS (SELECT account_id, security_id, arg_max(a, n) AS a, arg_max(b, n) AS b, arg_max(balance, n) AS q, min(balance) AS low FROM run GROUP BY ALL)
      SELECT account_id, security_id, 1000::BIGINT AS opening_quantity, {r("(q * 120000 - a) / nullif(b, 0)", 0)} AS opening_cost, CASE WHEN low < 0 THEN 'unreconciled' WHEN b = 0 THEN 'full' WHEN (q * 120000 - a) / b >= 0 THEN 'partial' ELSE 'partial_uncosted' END AS coverage, {r("b", 6)} AS opening_share_left FROM e""",
    "opening_quantity": f"{BASE}, l AS (SELECT account_id, security_id, arg_max(quantity, as_of_date) AS q FROM snap GROUP BY ALL), f AS (SELECT account_id, security_id, sum(sq)::BIGINT AS c FROM ledger GROUP BY ALL) SELECT account_id, security_id, q - c AS opening_quantity FROM l JOIN f USING (account_id, security_id)",
    "income_and_tax": f"WITH {LEDGER} SELECT account_id, security_id, sum(CASE WHEN tx_type = 'reinvest' THEN gross END)::BIGINT AS income, sum(tax)::BIGINT AS tax, sum(fee)::BIGINT AS fee, min(CASE WHEN tx_type = 'buy' THEN trade_date END) AS first_buy FROM ledger GROUP BY ALL",
    "occurrence_no": f"{OCC} SELECT l_orderkey, l_linenumber, l_partkey, security_id, occurrence FROM occ",
    "dedup_key": f"{OCC}, k AS (SELECT sha256(concat_ws('|', account_id::VARCHAR, security_id::VARCHAR, trade_date::VARCHAR, tx_type, quantity::VARCHAR, occurrence::VARCHAR)) AS k FROM occ) SELECT substr(k, 1, 2) AS shard, count(*) AS rows, count(DISTINCT k) AS keys, min(k) AS first_key FROM k GROUP BY 1",
    "closed_positions": f"WITH {LEDGER}, o AS (SELECT DISTINCT account_id, security_id FROM ledger WHERE trade_date >= DATE '2000-01-01') SELECT account_id, security_id, sum(sq)::BIGINT AS net, max(trade_date) AS last_trade FROM ledger ANTI JOIN o USING (account_id, security_id) GROUP BY ALL",
    "tag_summary": f"{WEIGHTS} SELECT tag_id::BIGINT AS tag_id, {r('sum(part)', 0)} AS value, count(*) AS holding_count FROM shares GROUP BY 1",
    "untagged_remainder": f"{WEIGHTS} SELECT security_id, weight::BIGINT AS weight, {r('part', 0)} AS value FROM shares WHERE tag_id = 0",
    "under_allocated": f"{WEIGHTS} SELECT security_id, sum(weight)::BIGINT AS used, any_value(h.value)::BIGINT AS value FROM w JOIN h USING (security_id) GROUP BY security_id HAVING sum(weight) < 100",
    "portfolio_ratio": f"{WEIGHTS}, m AS (SELECT security_id, sum(weight) AS m FROM w WHERE tag_id IN (1, 2, 5) GROUP BY ALL) SELECT sec.security_id, {r('CASE WHEN sec.security_id % 13 = 0 THEN 0 WHEN sec.security_id % 11 = 0 THEN 1 ELSE least(coalesce(m, 0) / 100.0::DOUBLE, 1.0) END')} AS ratio FROM sec LEFT JOIN m USING (security_id)",
    "breakdown_grouping_sets": f"{VALUED} SELECT asset_class, account_id, region_id, sum(value)::BIGINT AS value, count(*) AS lots FROM lots JOIN sec USING (security_id) GROUP BY GROUPING SETS ((asset_class), (account_id), (region_id))",
    "rule_match": """WITH p AS (SELECT lower(concat_ws(' ', p_name, p_type)) AS n FROM part) SELECT CASE WHEN regexp_matches(n, 'steel|copper') THEN 'metals' WHEN regexp_matches(n, 'large') AND NOT regexp_matches(n, 'brass') THEN 'large'
      WHEN regexp_matches(n, 'small|medium') THEN 'small' WHEN regexp_matches(n, 'plated') THEN 'plated' END AS rule_tag, count(*) AS parts FROM p GROUP BY 1""",
    "resolve_by_code_then_name": f"""WITH p AS (SELECT p_partkey AS id, {KEY.format("p_name")} AS k FROM part), n AS (SELECT id AS ref, CASE WHEN id % 3 = 0 THEN 'C' || id END AS code, CASE WHEN id % 5 = 0 THEN k || 'x' ELSE k END AS k FROM p),
      c AS (SELECT 'C' || id AS code, id AS by_code FROM p WHERE id % 6 = 0), a AS (SELECT k, min(id) AS by_alias FROM p GROUP BY k HAVING min(id) % 2 = 0), u AS (SELECT k, min(id) AS by_key FROM p GROUP BY k HAVING count(*) = 1)
      SELECT ref, coalesce(by_code, by_alias, by_key) AS security_id, CASE WHEN by_code IS NOT NULL THEN 'code' WHEN by_alias IS NOT NULL THEN 'alias' WHEN by_key IS NOT NULL THEN 'name' ELSE 'none' END AS resolved_by FROM n LEFT JOIN c USING (code) LEFT JOIN a USING (k) LEFT JOIN u USING (k)""",
    "snapshot_diff": f"""{BASE}, o AS (SELECT * FROM snap WHERE as_of_date = DATE '1998-05-31'), n AS (SELECT * FROM snap WHERE as_of_date = DATE '1998-06-30')
      SELECT coalesce(o.account_id, n.account_id) AS account_id, coalesce(o.security_id, n.security_id) AS security_id, o.quantity AS old_quantity, o.cost AS old_cost, n.quantity AS new_quantity, n.cost AS new_cost,
      CASE WHEN o.account_id IS NULL THEN 'new' WHEN n.account_id IS NULL THEN 'missing' WHEN o.quantity IS DISTINCT FROM n.quantity THEN 'qty_changed' WHEN o.cost IS DISTINCT FROM n.cost THEN 'cost_changed' ELSE 'unchanged' END AS status
      FROM o FULL JOIN n ON o.account_id = n.account_id AND o.security_id = n.security_id""",
    "transfer_candidates": f"""WITH {LEDGER}, {REFS}, j AS (SELECT o.ref AS out_ref, i.ref AS in_ref, (i.trade_date - o.trade_date)::BIGINT AS days, i.account_id AS acc, abs(o.quantity - i.quantity) AS gap FROM refs o JOIN refs i ON o.security_id = i.security_id AND o.account_id <> i.account_id
      AND i.trade_date - o.trade_date BETWEEN -7 AND 30 WHERE o.tx_type = 'sell' AND i.tx_type = 'buy'),
      k AS (SELECT *, row_number() OVER (PARTITION BY out_ref ORDER BY gap <> 0, days < 0, abs(days), gap, acc, in_ref) AS rank FROM j) SELECT out_ref, in_ref, days, gap, rank FROM k WHERE rank <= 3""",
    "price_verify": f"""{BASE}, {REFS}, j AS (SELECT r.security_id, r.ref, any_value(r.gross // r.quantity) AS u, arg_min(p.price, p.date) AS price FROM refs r LEFT JOIN prices p ON p.security_id = r.security_id AND p.date BETWEEN r.trade_date AND r.trade_date + 4 GROUP BY ALL)
      SELECT security_id, count(*) AS trades, count(price) AS priced, sum((price IS NOT NULL AND abs(u - price) <= 0.3::DOUBLE * price)::INT)::BIGINT AS confirmed FROM j GROUP BY security_id""",
    "dup_security_survivor": """WITH t AS (SELECT l_partkey, count(*) AS trades, max(l_shipdate)::DATE AS last_trade FROM lineitem GROUP BY 1), s AS (SELECT p_partkey AS security_id, p_name, coalesce(trades, 0) AS trades, last_trade FROM part LEFT JOIN t ON p_partkey = l_partkey)
      SELECT security_id, first_value(security_id) OVER (PARTITION BY p_name ORDER BY trades DESC, last_trade DESC NULLS LAST, security_id) AS survivor, count(*) OVER (PARTITION BY p_name) AS members FROM s""",
    "unexplained_holdings": f"{BASE}, l AS (SELECT account_id, security_id, arg_max(quantity, as_of_date) AS quantity FROM snap GROUP BY ALL) SELECT * FROM l ANTI JOIN (SELECT * FROM ledger WHERE tx_type = 'buy') b USING (account_id, security_id)",
    "quantity_unique_match": f"""WITH {LEDGER}, l AS (SELECT account_id, security_id, sum(quantity)::BIGINT AS total FROM ledger WHERE tx_type = 'sell' GROUP BY ALL), r AS (SELECT account_id, security_id, sum(quantity)::BIGINT AS total FROM ledger WHERE tx_type = 'buy' GROUP BY ALL),
      l1 AS (SELECT account_id, total, min(security_id) AS l_security FROM l GROUP BY ALL HAVING count(*) = 1), r1 AS (SELECT account_id, total, min(security_id) AS r_security FROM r GROUP BY ALL HAVING count(*) = 1) SELECT account_id, total, l_security, r_security FROM l1 JOIN r1 USING (account_id, total)""",
    "code_components": """WITH RECURSIVE p AS (SELECT DISTINCT l_suppkey AS entity, l_partkey AS code FROM lineitem), e AS (SELECT DISTINCT a.entity AS a, b.entity AS b FROM p a JOIN p b USING (code)),
      reach AS (SELECT a AS entity, a AS other FROM e UNION SELECT r.entity, e.b FROM reach r JOIN e ON e.a = r.other) SELECT entity, min(other) AS component FROM reach GROUP BY entity""",
    "code_components_whole": """WITH RECURSIVE p AS (SELECT DISTINCT l_suppkey AS entity, l_partkey AS code FROM lineitem), e AS (SELECT DISTINCT a.entity AS a, b.entity AS b FROM p a JOIN p b USING (code)),
      reach AS (SELECT a AS entity, a AS other FROM e UNION SELECT r.entity, e.b FROM reach r JOIN e ON e.a = r.other) SELECT entity, min(other) AS component FROM reach GROUP BY entity""",
    "column_stats": f"""WITH c AS (SELECT unnest([{{'col': 'c_custkey', 'v': c_custkey::VARCHAR}}, {{'col': 'c_name', 'v': c_name}}, {{'col': 'c_nationkey', 'v': c_nationkey::VARCHAR}}, {{'col': 'c_mktsegment', 'v': c_mktsegment}}], recursive := true) FROM customer)
      SELECT col, count(*) AS cells, count(v) AS filled, count(DISTINCT v) AS distinct_values, sum(regexp_full_match(v, '-?[0-9]+(\\.[0-9]+)?')::INT)::BIGINT AS numbers, max(length(v)) AS longest, {r("avg(length(v))")} AS mean_length FROM c GROUP BY col""",
    "identity_check": "SELECT l_returnflag, count(*) AS n, sum((abs(l_quantity * p_retailprice - l_extendedprice) <= 0.1::DOUBLE * l_extendedprice)::INT)::BIGINT AS hits FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
    "normalize_name": f"SELECT {KEY.format('''p_name || ' (12)' ''')} AS name_key, count(*) AS parts, min(p_partkey) AS first_part FROM part GROUP BY 1",
    "parse_amount": "SELECT c_mktsegment, count(c_acctbal) AS parsed, sum(round(c_acctbal * 100))::BIGINT AS cents FROM customer GROUP BY 1",
    "parse_date_multi": "SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders GROUP BY 1",
    "tx_type_classify": f"WITH {LEDGER} SELECT tx_type, count(*) AS n, sum(sq)::BIGINT AS net_quantity FROM ledger GROUP BY 1",
    "month_summary": f"WITH {LEDGER} SELECT date_trunc('month', trade_date)::DATE AS month, count(*) AS n, sum((tx_type = 'buy')::INT)::BIGINT AS buy, sum((tx_type = 'reinvest')::INT)::BIGINT AS reinvest, sum((tx_type = 'sell')::INT)::BIGINT AS sell, sum(gross)::BIGINT AS gross FROM ledger GROUP BY 1",
    "stream_tumbling": "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, sum(floor(value * 100 + 0.5)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1, 2",
    "stream_dedup_count": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1",
    "stream_session": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
      SELECT min(ts)::TIMESTAMP AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k""",
    "price_priority": f"""{BASE}, u AS (SELECT security_id, date, price, 'linked' AS source, 2 AS ord FROM prices UNION ALL SELECT security_id, date, price + 7, 'manual', 1 FROM prices WHERE security_id % 5 = 0 AND month(date) % 2 = 0)
      SELECT security_id, date, arg_min(price, ord) AS price, arg_min(source, ord) AS source FROM u GROUP BY ALL""",
    "latest_reported": f"{BASE} SELECT security_id, arg_max(price, date) FILTER (month(date) % 3 = 0) AS reported, max(date) FILTER (month(date) % 3 = 0) AS date FROM prices GROUP BY security_id",
    "upsert_snapshot": f"""{BASE} SELECT account_id, security_id, as_of_date, quantity + CASE WHEN as_of_date = DATE '1998-06-30' AND security_id % 2 = 0 THEN 1 ELSE 0 END AS quantity FROM snap WHERE as_of_date BETWEEN DATE '1998-05-01' AND DATE '1998-06-30'""",
    "usage_counts": f"{BASE}, {SEC}, u AS (SELECT security_id FROM ledger UNION ALL SELECT security_id FROM snap) SELECT sec.security_id, count(u.security_id) AS uses FROM sec LEFT JOIN u USING (security_id) GROUP BY ALL",
    "prefix_unique": """WITH n AS (SELECT DISTINCT p_name FROM part), c AS (SELECT DISTINCT substr(p_name, 1, length(p_name) - 3) AS short FROM n)
      SELECT short, min(p_name) AS full_name FROM c JOIN n ON starts_with(p_name, short) GROUP BY short HAVING count(*) = 1""",
    "class_drilldown": f"{VALUED} SELECT security_id, sum(value)::BIGINT AS value, sum(pl)::BIGINT AS pl, sum(day_change)::BIGINT AS day_change, bool_or(day_change IS NULL) AS day_change_partial FROM lots JOIN sec USING (security_id) WHERE asset_class = 'NATION_7' GROUP BY security_id",
    "included_totals": f"{VALUED} SELECT region_id, region_id NOT IN (2, 4) AS in_total, sum(value)::BIGINT AS value, CASE WHEN region_id NOT IN (2, 4) THEN sum(value)::BIGINT END AS value_in_total, count(*) AS lots FROM lots JOIN sec USING (security_id) GROUP BY region_id",
    "account_rollup": f"{VALUED} SELECT n_nationkey::BIGINT AS account_id, n_name AS account, sum(value)::BIGINT AS value, count(DISTINCT security_id) AS holdings FROM nation LEFT JOIN lots l ON l.account_id = n_nationkey GROUP BY ALL",
    "zero_transitions": f"{BASE}, l AS (SELECT *, lag(quantity) OVER (PARTITION BY account_id, security_id ORDER BY as_of_date) AS before FROM snap) SELECT account_id, security_id, as_of_date, before, quantity FROM l WHERE before >= 1000 AND quantity < 1000",
    "adjacent_pairs": f"""{BASE}, l AS (SELECT account_id, security_id, as_of_date, quantity, lag(as_of_date) OVER w AS prev_date, lag(quantity) OVER w AS prev_quantity, row_number() OVER (PARTITION BY account_id, security_id ORDER BY as_of_date DESC) AS n
      FROM snap WINDOW w AS (PARTITION BY account_id, security_id ORDER BY as_of_date)) SELECT * FROM l WHERE prev_date IS NOT NULL AND n <= 6""",
    "even_sample": f"""WITH {LEDGER}, r AS (SELECT *, row_number() OVER (ORDER BY trade_date, l_orderkey, l_linenumber, l_partkey) - 1 AS position, count(*) OVER () AS total FROM ledger)
      SELECT position, trade_date, l_orderkey, l_linenumber, l_partkey FROM r WHERE position = 0 OR (position * 200) // total <> ((position - 1) * 200) // total""",
    "longest_run": f"""WITH {LEDGER}, d AS (SELECT DISTINCT account_id, trade_date FROM ledger), i AS (SELECT *, trade_date - row_number() OVER (PARTITION BY account_id ORDER BY trade_date)::INT AS island FROM d),
      g AS (SELECT account_id, island, count(*) AS days, min(trade_date) AS start FROM i GROUP BY ALL) SELECT account_id, max(days) AS days, arg_min(start, (-days, start)) AS start FROM g GROUP BY account_id""",
    "median_abs": f"{VALUED} SELECT asset_class, {r('median(abs(pl))', 1)} AS median_abs_pl FROM lots JOIN sec USING (security_id) GROUP BY asset_class",
    "mode_larger": f"WITH {LEDGER}, n AS (SELECT tx_type, quantity, count(*) AS n FROM ledger GROUP BY ALL) SELECT tx_type, arg_max(quantity, (n, quantity)) AS quantity, max(n) AS n FROM n GROUP BY tx_type",
    "weighted_cost": f"""{VALUED}, u AS (SELECT *, CASE WHEN (security_id + account_id * 13) % 211 <> 0 THEN lot_cost // quantity END AS unit FROM lots)
      SELECT account_id, CASE WHEN bool_and(unit IS NOT NULL AND unit > 0) THEN {ratio("sum(quantity * unit)", "sum(quantity)", 2)} END AS avg_cost FROM u GROUP BY account_id""",
    "security_set_ops": f"""WITH {LEDGER}, a AS (SELECT DISTINCT account_id, security_id FROM ledger WHERE trade_date BETWEEN DATE '1998-05-01' AND DATE '1998-05-31'), b AS (SELECT DISTINCT account_id, security_id FROM ledger WHERE trade_date BETWEEN DATE '1998-06-01' AND DATE '1998-06-30')
      SELECT *, 'both' AS part FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT *, 'may_only' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'june_only' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "early_negative": f"""WITH {LEDGER}, d AS (SELECT account_id, security_id, trade_date, sum(sum(sq)) OVER (PARTITION BY account_id, security_id ORDER BY trade_date) AS balance FROM ledger GROUP BY account_id, security_id, trade_date)
      SELECT account_id, security_id, min(trade_date) AS first_negative, arg_min(balance, trade_date)::BIGINT AS balance FROM d WHERE balance < 0 GROUP BY ALL""",
    "numeric_roles": ROLES,
    "date_orders": """WITH d AS (SELECT o_orderstatus, max(CASE o_orderstatus WHEN 'F' THEN day(o_orderdate) WHEN 'O' THEN month(o_orderdate) ELSE year(o_orderdate) END) AS a, max(CASE o_orderstatus WHEN 'F' THEN month(o_orderdate) WHEN 'O' THEN day(o_orderdate) ELSE month(o_orderdate) END) AS b, count(*) AS parsed FROM orders GROUP BY 1)
      SELECT o_orderstatus, CASE WHEN a > 31 THEN 'ymd' WHEN a > 12 AND b <= 12 THEN 'dmy' WHEN b > 12 AND a <= 12 THEN 'mdy' ELSE 'ambiguous' END AS date_order, parsed FROM d""",
    "sign_conventions": f"""WITH {LEDGER} SELECT account_id % 3 AS file, CASE account_id % 3 WHEN 0 THEN 'signed_quantity' WHEN 1 THEN 'signed_amount' ELSE 'unsigned' END AS convention, count(*) AS n FROM ledger GROUP BY ALL""",
}
