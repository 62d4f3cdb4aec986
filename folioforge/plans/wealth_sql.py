"""DuckDB SQL for the queries of wealth.py."""

from __future__ import annotations

from .oracle import BASE, CLOSES, LEDGER, SNAP, r
from ..operators import classify as words
from .wealth import INSTRUMENT, LABELS, RATIOS, RICH

COLUMNS = ", ".join(f"{x} AS {k}" for k, x in RICH.items())
FULL = f"WITH {LEDGER}, rich AS (SELECT *, {COLUMNS} FROM ledger)"
INS = f"ins AS (SELECT s_suppkey AS security_id, s_name AS name, {', '.join(f'{x} AS {k}' for k, x in INSTRUMENT.items())} FROM (SELECT *, s_suppkey AS security_id FROM supplier))"
RATES = "rates AS (SELECT CASE security_id WHEN 1 THEN 'USD' ELSE 'EUR' END AS currency, date, price / 100000.0::DOUBLE AS rate FROM prices WHERE security_id IN (1, 2) AND month(date) % 2 = 0)"
DAY, PREV = "DATE '1998-06-30'", "DATE '1998-05-31'"


def route(q: str, price: str, rate: str, what: str) -> str:
    """The value or the route of a lot, rule by rule."""
    fx = f"(CASE WHEN currency = 'JPY' THEN 1.0::DOUBLE ELSE {rate} END)"
    p = f"(CASE WHEN asset_class = 'pension' AND linked AND {q} <= 1 THEN NULL ELSE {price}::DOUBLE END)"
    value = [f"{q} * {fx}", "reported", f"{q}::DOUBLE * {p} / divisor * {fx}", "reported", f"{q}", "NULL"]
    names = ["'cash'", "'reported'", "'price'", "'reported'", "'point'", "'none'"]
    out = names if what == "route" else [f"({v})::DOUBLE" for v in value]
    return f"CASE WHEN asset_class = 'cash' AND {fx} IS NOT NULL THEN {out[0]} WHEN asset_class = 'cash' THEN {out[1]} WHEN {value[2]} IS NOT NULL THEN {out[2]} WHEN reported IS NOT NULL THEN {out[3]} WHEN asset_class = 'point' THEN {out[4]} ELSE {out[5]} END"


LAST = lambda table, cols, keys, until: f"(SELECT {keys}, {', '.join(f'arg_max({c}, {d}) AS {n}' for c, d, n in cols)} FROM {table} WHERE {cols[0][1]} <= {until} GROUP BY ALL)"
LOTS = f"""c0 AS {LAST('snap', [('quantity', 'as_of_date', 'q'), ('cost', 'as_of_date', 'cost'), ('bought', 'as_of_date', 'bought')], 'account_id, security_id', DAY)},
c1 AS {LAST('snap', [('quantity', 'as_of_date', 'oq')], 'account_id, security_id', PREV)},
p0 AS {LAST('prices', [('price', 'date', 'price')], 'security_id', DAY)}, p1 AS {LAST('prices', [('price', 'date', 'prev_price')], 'security_id', PREV)},
r0 AS {LAST('rates', [('rate', 'date', 'rate')], 'currency', DAY)}, r1 AS {LAST('rates', [('rate', 'date', 'prev_rate')], 'currency', PREV)},
l0 AS (SELECT account_id, ins.*, CASE WHEN account_id % 6 = 1 THEN 1 ELSE q END AS quantity, CASE WHEN account_id % 6 = 1 THEN 1 ELSE coalesce(oq, q) END AS prev_quantity,
  CASE WHEN (account_id + security_id) % 4 <> 0 THEN floor(cost / greatest(bought, 1))::BIGINT END AS avg_cost, CASE WHEN (account_id + security_id) % 3 = 0 THEN (q * 100)::DOUBLE END AS reported,
  CASE WHEN security_id % 10 <> 6 THEN price END AS price, prev_price, rate, prev_rate
  FROM c0 LEFT JOIN c1 USING (account_id, security_id) JOIN ins USING (security_id) LEFT JOIN p0 USING (security_id) LEFT JOIN p1 USING (security_id) LEFT JOIN r0 USING (currency) LEFT JOIN r1 USING (currency)),
lots AS (SELECT *, {route('quantity', 'price', 'rate', 'value')} AS value, {route('quantity', 'price', 'rate', 'route')} AS route, {route('prev_quantity', 'prev_price', 'prev_rate', 'value')} AS before, {route('prev_quantity', 'prev_price', 'prev_rate', 'route')} AS before_route FROM l0)"""
ROUTED = f"{BASE}, {RATES}, {INS}, {LOTS}"
PRICED = "IN ('cash', 'price')"
PREVIOUS = f"CASE WHEN (route {PRICED} AND before_route {PRICED}) OR (asset_class = 'point' AND route NOT {PRICED}) THEN before END"


def cost(avg: str = "avg_cost") -> str:
    return f"(CASE WHEN asset_class = 'pension' THEN ({avg})::DOUBLE ELSE quantity * ({avg})::DOUBLE / divisor * (CASE WHEN currency = 'JPY' THEN 1.0::DOUBLE ELSE rate END) END)"


AMOUNT = """coalesce(nullif(abs(gross_amount), 0), CASE WHEN kind IN ('buy', 'reinvest') THEN nullif(abs(net_amount), 0) - (fee + tax) ELSE nullif(abs(net_amount), 0) + (fee + tax) END, abs(quantity) * abs(unit_price), 0)"""
PROCEEDS = f"(CASE WHEN coalesce(gross_amount, 0) = 0 AND coalesce(net_amount, 0) = 0 AND unit_price IS NOT NULL THEN {AMOUNT} / divisor ELSE {AMOUNT} END)"
MULT = "CASE WHEN kind IN ('buy', 'reinvest', 'transfer_in', 'sell', 'transfer_out') THEN 1.0 WHEN kind = 'split' AND split_ratio > 0 THEN split_ratio WHEN kind = 'split' AND quantity IS NOT NULL THEN 1.0 END"
DELTA = "CASE WHEN kind IN ('buy', 'reinvest', 'transfer_in') THEN quantity WHEN kind IN ('sell', 'transfer_out') THEN -quantity WHEN kind = 'split' AND split_ratio > 0 THEN 0 WHEN kind = 'split' THEN quantity END"
KEY = "l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR || '-' || l_partkey::VARCHAR"
CODE = "CASE p_partkey % 4 WHEN 0 THEN (p_partkey % 9000 + 1000)::VARCHAR || '0' WHEN 1 THEN (p_partkey % 10)::VARCHAR || 'A' || (p_partkey % 90 + 10)::VARCHAR WHEN 2 THEN ' ' || (p_partkey % 9000 + 1000)::VARCHAR ELSE p_brand END"

RATIO = r"'^([0-9]+(?:\.[0-9]+)?)\s*[:：対]\s*([0-9]+(?:\.[0-9]+)?)$'"


def label_key(x: str) -> str:
    """A label without blanks, marks and unit, in lower case; the test's labels are in compatibility form but for brackets."""
    return f"regexp_replace(regexp_replace(lower(trim({x})), '{words.MARKS}', '', 'g'), '{words.UNIT}', '')"


def type_rules(t: str) -> list[tuple[str, str, float]]:
    has = lambda *groups: "(" + " OR ".join(f"contains({t}, '{w}')" for g in groups for w in g) + ")"
    trade = has(words.BUY, words.SELL)
    return [
        (has(words.DELIVERED), "sell", 1.0), (has(words.TAKEN), "buy", 1.0), (f"{has(words.MARGIN)} AND ({trade} OR contains({t}, '建'))", "other", 0.0), (f"{has(words.REINVEST)} AND NOT {has(words.TRANSFER_IN, words.TRANSFER_OUT)}", "reinvest", 1.0),
        (has(words.RETURN_OF_CAPITAL), "return_of_capital", 1.0), (f"{has(words.SPLIT)} AND NOT {trade}", "split", 1.0), (f"{has(words.DIVIDEND)} AND NOT {trade}", "dividend", 1.0), (has(words.POINTS), "cash_in", 0.9), (has(words.SELL), "sell", 1.0),
        (has(words.BUY), "buy", 1.0), (has(words.TRANSFER_IN), "transfer_in", 0.8), (has(words.TRANSFER_OUT), "transfer_out", 0.8), (has(words.CASH_OUT), "cash_out", 0.9), (has(words.CASH_IN), "cash_in", 0.9), (has(words.CASH_EITHER), "cash_in", 0.5),
    ]


def type_of(head: str, whole: str, what: str) -> str:
    """kind or sure of a label: what stands outside of brackets, or the whole."""
    pick = lambda t: " ".join(f"WHEN {test} THEN " + (f"'{kind}'" if what == "kind" else f"{sure}::DOUBLE") for test, kind, sure in type_rules(t) if kind != "other")
    margin = lambda t: type_rules(t)[2][0]
    none = "'other'" if what == "kind" else "0::DOUBLE"
    one = lambda t, rest: f"CASE WHEN {type_rules(t)[0][0]} THEN {chr(39) + 'sell' + chr(39) if what == 'kind' else '1::DOUBLE'} WHEN {type_rules(t)[1][0]} THEN {chr(39) + 'buy' + chr(39) if what == 'kind' else '1::DOUBLE'} WHEN {margin(t)} THEN {rest} {pick(t)} ELSE {rest} END"
    return one(head, one(whole, none))


KEYED = lambda x: f"{label_key(f'regexp_replace({x}, {chr(39)}{words.BRACKETS}{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})')} AS head, {label_key(x)} AS whole"
LABEL_LIST = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"

SQL: dict[str, str] = {
    "split_ratio_parse": f"""WITH x AS (SELECT {RATIOS.replace('STRING', 'VARCHAR')} AS raw FROM lineitem), y AS (SELECT raw, count(*) AS n, try_cast(nullif(regexp_extract(trim(raw), {RATIO}, 1), '') AS DOUBLE) AS a, try_cast(nullif(regexp_extract(trim(raw), {RATIO}, 2), '') AS DOUBLE) AS b, try_cast(trim(raw) AS DOUBLE) AS one FROM x GROUP BY raw)
SELECT raw, n, {r('CASE WHEN a > 0 THEN b / a WHEN a IS NULL AND one > 0 THEN one END', 4)} AS ratio FROM y""",
    "no_movement_rows": f"{FULL}, x AS (SELECT kind, gross_amount, net_amount, fee, tax, CASE WHEN l_orderkey % 4 = 0 THEN 0 WHEN l_orderkey % 4 = 1 THEN NULL ELSE quantity END AS quantity FROM rich) SELECT kind, count(*) AS n, count(*) FILTER (coalesce(quantity, 0) = 0 AND coalesce(gross_amount, 0) = 0 AND coalesce(net_amount, 0) = 0 AND coalesce(fee, 0) = 0 AND coalesce(tax, 0) = 0) AS without_movement FROM x GROUP BY 1",
    "tx_labels_classified": f"""WITH x AS (SELECT ({LABEL_LIST})[(l_partkey * 7 + l_linenumber) % {len(LABELS) + 1} + 1] AS label FROM lineitem), g AS (SELECT label, count(*) AS n FROM x GROUP BY 1), k AS (SELECT *, {KEYED('label')} FROM g)
SELECT label, n, CASE WHEN label IS NOT NULL THEN {type_of('head', 'whole', 'kind')} END AS kind, CASE WHEN label IS NOT NULL THEN {type_of('head', 'whole', 'sure')} END AS sure FROM k""",
    "divisor_inference": f"""{FULL}, d AS (SELECT security_id, quantity, gross, floor(gross / quantity) * divisor AS quote FROM rich), t AS (SELECT *, unnest([1, 100, 1000, 10000]) AS v FROM d),
g AS (SELECT security_id, v, count(*) FILTER (abs(quantity * quote / v - gross) <= 1 + quantity * 0.5::DOUBLE / v) AS hits, count(*) AS n FROM t GROUP BY ALL)
SELECT security_id, v AS divisor, hits, n FROM g QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY hits DESC, v) = 1""",
    "range_starts": f"WITH {LEDGER}, o AS (SELECT account_id, min(trade_date) AS oldest FROM ledger GROUP BY 1), k AS (SELECT * FROM (VALUES ('7d', 7), ('30d', 30), ('90d', 90), ('1y', 365), ('all', 1825)) t(range, days)) SELECT account_id, range, CASE WHEN range = 'all' THEN least({DAY} - days, oldest) ELSE {DAY} - days END AS start FROM o, k",
    "batch_rollback": f"""WITH {LEDGER}, t AS (SELECT {KEY} AS k, l_orderkey, l_partkey, quantity, 'B' || (l_orderkey % 6)::VARCHAR AS b FROM ledger), links AS (SELECT k, b FROM t UNION ALL SELECT k, 'B' || ((l_orderkey + l_partkey) % 6)::VARCHAR FROM t WHERE l_partkey % 3 = 0),
o AS (SELECT k, arg_min(b, (b[2:]::BIGINT + 4) % 6) AS owner FROM links WHERE b <> 'B3' GROUP BY 1) SELECT CASE WHEN b = 'B3' THEN owner ELSE b END AS batch_id, count(*) AS n, sum(quantity)::BIGINT AS quantity FROM t LEFT JOIN o USING (k) WHERE b <> 'B3' OR owner IS NOT NULL GROUP BY 1""",
    "lot_value_routes": f"{ROUTED} SELECT account_id, security_id, asset_class, {r('value', 2)} AS value, route, route {PRICED} AS has_price FROM lots",
    "previous_same_route": f"{ROUTED}, v AS (SELECT *, {PREVIOUS} AS pv FROM lots) SELECT account_id, security_id, {r('pv', 2)} AS prev_value, {r('value - pv', 2)} AS day_change FROM v",
    "lot_costs": f"{ROUTED} SELECT account_id, security_id, {r(cost(), 2)} AS lot_cost FROM lots",
    "summary_display_currency": f"{ROUTED}, u AS (SELECT arg_max(rate, date) AS d FROM rates WHERE currency = 'USD' AND date <= {DAY}), g AS (SELECT asset_class, sum(value) AS v, count(*) AS lots, count(*) FILTER (value IS NULL) AS unvalued FROM lots GROUP BY 1) SELECT asset_class, {r('v / d', 2)} AS value, lots, unvalued FROM g, u",
    "summary_json": f"{ROUTED}, g AS (SELECT asset_class, sum(value) AS v, sum(CASE WHEN value IS NOT NULL THEN {cost()} END) AS c FROM lots GROUP BY 1) SELECT asset_class, {r('v', 2)}::DECIMAL(38, 2)::VARCHAR AS value, {r('v * 100 / nullif(c, 0)', 2)}::DECIMAL(38, 2)::VARCHAR AS value_to_cost_pct FROM g",
    "fx_asof": f"""{FULL}, prices AS (SELECT security_id, last_day(trade_date) AS date, (sum(gross) // sum(quantity))::BIGINT AS price FROM ledger GROUP BY ALL), {RATES}, f AS (SELECT currency, min(date) AS d0, arg_min(rate, date) AS r0 FROM rates GROUP BY 1),
j AS (SELECT x.currency, x.gross, CASE WHEN x.currency = 'JPY' THEN 1.0 ELSE coalesce(y.rate, f.r0) END AS rate FROM rich x ASOF LEFT JOIN rates y ON x.currency = y.currency AND x.trade_date >= y.date LEFT JOIN f ON f.currency = x.currency)
SELECT currency, count(*) AS lookups, count(rate) AS found, {r('sum(gross * rate) / 1e6', 1)} AS converted FROM j GROUP BY 1""",
    "unpriced_and_needs_valuation": f"""{ROUTED}, g AS (SELECT security_id, source_type, bool_and(value IS NULL) AS unvalued, bool_or(price IS NOT NULL) AS priced FROM lots WHERE NOT inactive GROUP BY ALL),
l AS (SELECT security_id, CASE WHEN source_type = 'series' AND NOT priced THEN 'unpriced' WHEN source_type IN ('manual', 'none') AND unvalued THEN 'needs_valuation' END AS list FROM g) SELECT * FROM l WHERE list IS NOT NULL""",
    "source_partition": f"WITH {INS} SELECT CASE WHEN inactive THEN 'skipped' WHEN source_type = 'manual' THEN 'manual' WHEN source_type = 'remote' THEN 'remote' WHEN source_type = 'series' AND linked THEN 'linked' ELSE 'local' END AS part, asset_class, count(*) AS n FROM ins GROUP BY ALL",
    "estimated_flags": f"{FULL}, {INS}, a AS (SELECT security_id, max(trade_date) AS appraised FROM rich WHERE kind = 'other' GROUP BY 1) SELECT security_id, appraised, coalesce(appraised < {DAY}, false) AS estimated FROM ins LEFT JOIN a USING (security_id) WHERE linked",
    "currency_mismatch": f"{FULL}, {INS}, p AS (SELECT security_id, arg_max(CASE WHEN l_orderkey % 9 = 0 THEN 'GBP' ELSE currency END, (trade_date, l_orderkey, l_linenumber, l_partkey)) AS series_currency FROM rich GROUP BY 1) SELECT security_id, currency, series_currency FROM ins JOIN p USING (security_id) WHERE series_currency <> currency",
    "series_range": f"""{FULL}, prices AS (SELECT security_id, last_day(trade_date) AS date, (sum(gross) // sum(quantity))::BIGINT AS price FROM ledger GROUP BY ALL),
l AS (SELECT security_id, arg_max(currency, (trade_date, l_orderkey, l_linenumber, l_partkey)) AS currency FROM rich WHERE trade_date BETWEEN DATE '1997-03-31' AND DATE '1997-09-30' GROUP BY 1)
SELECT security_id, currency, count(*) AS n, min(date) AS first, max(date) AS last, sum(price)::BIGINT AS prices FROM prices LEFT JOIN l USING (security_id) WHERE date BETWEEN DATE '1997-03-31' AND DATE '1997-09-30' GROUP BY ALL""",
    "security_search": "SELECT p_type, count(*) AS n, min(p_partkey) AS first FROM part WHERE p_name ILIKE '%bolt%' OR p_brand ILIKE '%#13%' GROUP BY 1",
    "trade_amounts": f"{FULL}, a AS (SELECT kind, {AMOUNT} AS amount FROM rich) SELECT kind, count(*) AS n, sum(amount)::BIGINT AS amount, count(*) FILTER (amount = 0) AS missing FROM a GROUP BY 1",
    "acquisition_costs": f"{FULL} SELECT kind, divisor, {r(f'sum({PROCEEDS} + fee)', 0)} AS cost, {r(f'sum({PROCEEDS})', 0)} AS proceeds FROM rich GROUP BY ALL",
    "quantity_steps": f"{FULL} SELECT kind, count(*) AS n, count({MULT}) AS moving, {r(f'sum({DELTA})', 0)} AS delta, {r(f'sum({MULT})', 2)} AS mult FROM rich GROUP BY 1",
    "opening_with_splits": f"""{FULL}, {SNAP}, m AS (SELECT account_id, security_id, {MULT} AS mult, {DELTA} AS delta, row_number() OVER (PARTITION BY account_id, security_id ORDER BY trade_date, l_orderkey, l_linenumber, l_partkey) AS n FROM rich WHERE {MULT} IS NOT NULL),
p AS (SELECT *, coalesce(product(mult) OVER (PARTITION BY account_id, security_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1) AS later FROM m),
c AS (SELECT account_id, security_id, product(mult) AS alpha, sum(delta * later) AS beta FROM p GROUP BY ALL), s AS (SELECT account_id, security_id, arg_max(quantity, as_of_date) AS q FROM snap GROUP BY ALL)
SELECT account_id, security_id, {r('alpha', 4)} AS alpha, {r('beta', 2)} AS beta, {r('(q - beta) / alpha', 2)} AS opening FROM c JOIN s USING (account_id, security_id)""",
    "late_trades": f"""{FULL}, {SNAP}, s AS (SELECT account_id, security_id, max(as_of_date) AS d FROM snap WHERE as_of_date <= {DAY} GROUP BY ALL)
SELECT account_id, security_id, count(*) FILTER (trade_date > d) AS after_snapshot, count(*) FILTER (trade_date <= d) AS usable, max(CASE WHEN trade_date <= d THEN trade_date END) AS last_used FROM rich JOIN s USING (account_id, security_id) GROUP BY ALL""",
    "current_quantity": f"{BASE}, s AS (SELECT account_id, security_id, arg_max(quantity, as_of_date) AS q FROM snap GROUP BY ALL) SELECT security_id, sum(q)::BIGINT AS quantity FROM s GROUP BY 1 HAVING sum(q) <> 0",
    "weighted_anchor_cost": f"{ROUTED}, g AS (SELECT account_id, count(avg_cost) > 0 AND count(avg_cost) < count(*) AS mixed, {r('sum(quantity * avg_cost)::DOUBLE / nullif(sum(CASE WHEN avg_cost IS NOT NULL THEN quantity END)::DOUBLE, 0)', 2)} AS a, count(*) AS lots FROM lots GROUP BY 1) SELECT account_id, mixed, CASE WHEN NOT mixed THEN a END AS avg_cost, lots FROM g",
    "inferred_currency": f"{FULL}, g AS (SELECT account_id, currency, count(*) AS n, min((trade_date, l_orderkey, l_linenumber, l_partkey)) AS seen FROM rich GROUP BY ALL) SELECT account_id, currency, n FROM g QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY n DESC, seen) = 1",
    "classes_by_value": f"{ROUTED}, g AS (SELECT asset_class, {r('sum(value)', 2)} AS value FROM lots GROUP BY 1) SELECT *, row_number() OVER (ORDER BY asset_class = 'point', value DESC NULLS LAST, asset_class) AS position FROM g",
    "user_sort": """WITH c AS (SELECT c_nationkey, max(CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE c_name END) AS cell, max(CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE c_acctbal END) AS amount FROM customer GROUP BY 1)
SELECT c_nationkey, row_number() OVER (ORDER BY coalesce(cell, '') = '', cell NULLS FIRST, c_nationkey) AS up, row_number() OVER (ORDER BY coalesce(cell, '') = '', cell DESC NULLS LAST, c_nationkey) AS down, row_number() OVER (ORDER BY amount DESC NULLS LAST, c_nationkey) AS by_amount FROM c""",
    "portfolio_prorated": f"""{ROUTED}, v AS (SELECT *, {PREVIOUS} AS pv, {cost()} AS c, CASE WHEN security_id % 13 = 0 THEN 0.0::DOUBLE WHEN security_id % 11 = 0 THEN 1.0 ELSE least((security_id % 5) * 0.3::DOUBLE, 1.0) END AS share FROM lots)
SELECT currency, {r('sum(value * share)', 1)} AS value, {r('sum(c * share)', 1)} AS cost, {r('sum(CASE WHEN c IS NOT NULL THEN value END * share)', 1)} AS costed_value, {r('sum((value - pv) * share)', 1)} AS day_change, count(DISTINCT security_id) AS securities FROM v WHERE share > 0 GROUP BY 1""",
    "history_chunks": f"WITH {LEDGER}, d AS (SELECT security_id, min(trade_date) AS lo, least(max(trade_date), {DAY} - 1) AS hi FROM ledger GROUP BY 1), x AS (SELECT security_id, hi, unnest(range(0, (hi - lo) + 1, 365)) AS k, lo FROM d WHERE lo <= hi) SELECT security_id, lo + k::INTEGER AS start, least(lo + k::INTEGER + 364, hi) AS end FROM x",
    "freshness": f"{BASE} SELECT security_id, max(date) AS last, ({DAY} - max(date)) <= 35 AS fresh FROM prices WHERE date <= {DAY} AND (security_id % 4 <> 1 OR date < DATE '1998-04-01') GROUP BY 1",
    "statement_commit": f"""{BASE}, s AS (SELECT account_id, security_id, as_of_date, quantity FROM snap WHERE as_of_date >= {PREV}), d AS (SELECT * FROM s WHERE as_of_date = {DAY} AND account_id % 5 = 2), new AS (SELECT account_id, security_id, as_of_date, quantity + 3 AS quantity FROM d WHERE security_id % 4 <> 0),
o AS (SELECT * FROM s WHERE (account_id, as_of_date) NOT IN (SELECT DISTINCT account_id, as_of_date FROM new) UNION ALL SELECT * FROM new UNION ALL SELECT account_id, security_id, {DAY}, 0 FROM d WHERE security_id % 8 = 0)
SELECT account_id, as_of_date, count(*) AS lots, sum(quantity)::BIGINT AS quantity, count(*) FILTER (quantity = 0) AS zeroed FROM o GROUP BY ALL""",
    "replace_derived": f"""WITH {LEDGER}, o AS (SELECT account_id, security_id, 'B' || (count(*) % 4)::VARCHAR AS b FROM ledger WHERE trade_date < DATE '1997-01-01' GROUP BY ALL), n AS (SELECT account_id, security_id, count(*) AS n FROM ledger WHERE trade_date >= DATE '1996-07-01' GROUP BY ALL)
SELECT coalesce(CASE WHEN n % 3 = 0 THEN 'new' END, b) AS batch_id, count(*) AS rows, sum(n)::BIGINT AS n FROM n LEFT JOIN o USING (account_id, security_id) GROUP BY 1""",
    "purge_previews": "WITH e AS (SELECT event_id, ts, CASE WHEN event_type = 'purchase' THEN 'committed' ELSE 'preview' END AS status FROM events) SELECT status, count(*) AS n, min(event_id) AS first FROM e WHERE status <> 'preview' OR ts >= TIMESTAMP '2024-01-29 12:00:00' GROUP BY 1",
    "unique_violations": "SELECT p_brand AS code, count(*) AS n FROM part WHERE p_size < 30 AND p_size % 2 = 0 GROUP BY 1 HAVING count(*) > 1",
    "batch_row_counts": f"{BASE} SELECT n_nationkey::BIGINT AS account_id, CASE n_regionkey % 2 WHEN 0 THEN 'ledger' ELSE 'statement' END AS kind, CASE WHEN n_regionkey % 2 = 0 THEN (SELECT count(*) FROM ledger l WHERE l.account_id = n.n_nationkey) ELSE (SELECT count(*) FROM snap s WHERE s.account_id = n.n_nationkey) END AS rows FROM nation n",
    "normalized_codes": f"""WITH x AS (SELECT {CODE} AS raw FROM part), y AS (SELECT raw, replace(upper(trim(raw)), ' ', '') AS c FROM x), z AS (SELECT raw, CASE WHEN length(c) = 5 AND c LIKE '%0' AND regexp_matches(left(c, 4), '^[0-9][0-9A-Z]{{3}}$') THEN left(c, 4) WHEN regexp_matches(c, '^[0-9][0-9A-Z]{{3}}$') THEN c END AS code FROM y) SELECT code, count(*) AS n, min(raw) AS first_raw FROM z GROUP BY 1""",
    "currency_words": """WITH x AS (SELECT (['円', '米ドル', 'ユーロ', 'USD', 'us$', '€', 'JPY', '£', '?', NULL])[c_custkey % 10 + 1] AS word FROM customer)
SELECT word, count(*) AS n, CASE upper(word) WHEN '円' THEN 'JPY' WHEN '米ドル' THEN 'USD' WHEN 'ユーロ' THEN 'EUR' WHEN 'USD' THEN 'USD' WHEN 'US$' THEN 'USD' WHEN '€' THEN 'EUR' WHEN 'JPY' THEN 'JPY' WHEN '£' THEN 'GBP' END AS currency FROM x GROUP BY word""",
    "row_inclusion": f"""{FULL} SELECT CASE WHEN l_partkey % 10 < 7 THEN 'unsure' WHEN l_orderkey % 7 = 0 THEN 'unresolved' WHEN kind IN ('cash_in', 'cash_out') THEN 'cash' WHEN l_linenumber = 7 THEN 'duplicate' ELSE 'included' END AS decision, count(*) AS n FROM rich GROUP BY 1""",
    "header_fingerprints": "WITH x AS (SELECT p_partkey, sha1(array_to_string(list_sort(list_transform(string_split(p_type, ' '), lambda x: lower(replace(x, ' ', '')))), '|')) AS fingerprint FROM part) SELECT fingerprint, count(*) AS n, min(p_partkey) AS first FROM x GROUP BY 1",
    "external_merge": f"""{ROUTED}, a AS (SELECT asset_class, sum(value) AS v, count(*) AS n FROM lots GROUP BY 1 UNION ALL SELECT CASE event_type WHEN 'click' THEN 'coin' ELSE 'stock' END, sum(floor(value * 100 + 0.5)), count(*) FROM events WHERE event_type IN ('click', 'view') GROUP BY 1)
SELECT asset_class, {r('sum(v)', 1)} AS value, sum(n)::BIGINT AS rows FROM a GROUP BY 1""",
    "external_history": f"""WITH {CLOSES}, o AS (SELECT date, price AS own FROM closes WHERE event_type = 'view'), s AS (SELECT date, price * 0.25 AS added FROM closes WHERE event_type = 'click' AND dayofmonth(date) % 4 = 2)
SELECT o.date, {r('own + coalesce(added, 0)', 4)} AS value, added IS NOT NULL AS complete FROM o ASOF LEFT JOIN s ON o.date >= s.date""",
    "allocation_diff": f"""WITH {INS}, s AS (SELECT security_id, CASE security_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'zz' END AS g, CASE security_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS t FROM ins)
SELECT CASE WHEN g IS NULL THEN 'no-rule' WHEN g = 'zz' THEN 'missing-tag' WHEN t IS NULL THEN 'new' WHEN t = g THEN 'unchanged' ELSE 'change' END AS status, count(*) AS n, min(security_id) AS first FROM s GROUP BY 1""",
    "consistency_warnings": f"""{BASE}, o AS (SELECT account_id, security_id, security_id % 40 AS code FROM snap WHERE as_of_date = {PREV}), n AS (SELECT account_id, security_id, security_id % 40 AS code FROM snap WHERE as_of_date = {DAY})
SELECT account_id, code FROM n WHERE (account_id, security_id) NOT IN (SELECT account_id, security_id FROM o) INTERSECT SELECT account_id, code FROM o WHERE (account_id, security_id) NOT IN (SELECT account_id, security_id FROM n)""",
}
