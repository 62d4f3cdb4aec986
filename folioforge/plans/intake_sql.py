"""DuckDB SQL for the queries of intake.py."""

from __future__ import annotations

from .intake import DECORATED, DOUBLE, ROW, SECURITY
from .oracle import BASE, r
from .wealth_sql import FULL, KEYED, LABEL_LIST, LABELS, type_of, words

TEXT = lambda x: x.replace("STRING", "VARCHAR")
HAS = lambda c, *groups: "coalesce(" + " OR ".join(f"contains({c}, '{w}')" for g in groups for w in g) + ", false)"
ROWS = f"""{FULL}, rw AS (SELECT l_orderkey, l_linenumber, l_partkey, divisor, {', '.join(f'{TEXT(x)} AS {k}' for k, x in ROW.items())}, nullif(trim(({LABEL_LIST})[(l_partkey * 7 + l_linenumber) % {len(LABELS) + 9} + 1]), '') AS label FROM rich),
kd AS (SELECT *, {KEYED('label')} FROM rw),
ty AS (SELECT *, CASE WHEN label IS NULL THEN 'other' ELSE {type_of('head', 'whole', 'kind')} END AS said, CASE WHEN label IS NULL THEN 0 ELSE {type_of('head', 'whole', 'sure')} END AS sure FROM kd),
k1 AS (SELECT *, coalesce(trade_date, settle_date) AS day, coalesce(net, gross) AS amount, CASE WHEN said = 'other' AND sign_convention = 'signed_quantity' AND quantity <> 0 THEN CASE WHEN quantity > 0 THEN 'buy' ELSE 'sell' END WHEN said = 'other' AND sign_convention = 'signed_net' AND net <> 0 THEN CASE WHEN net < 0 THEN 'buy' ELSE 'sell' END ELSE said END AS k FROM ty),
k2 AS (SELECT * REPLACE (CASE WHEN (k IN ('cash_in', 'cash_out') AND sure < 0.9 AND amount IS NOT NULL) OR (k NOT IN ('cash_in', 'cash_out') AND contains(lower(concat_ws(' ', name, label)), 'mrf')) THEN CASE WHEN amount < 0 THEN 'cash_out' ELSE 'cash_in' END ELSE k END AS k), (name = '' AND code IS NULL) AS nosec FROM k1),
k3 AS (SELECT *, CASE WHEN k IN ('buy', 'reinvest', 'cash_out') THEN -abs(net) WHEN k IN ('sell', 'cash_in') THEN abs(net) ELSE net END AS n FROM k2),
k4 AS (SELECT *, k IN ('buy', 'sell', 'reinvest') AND nosec AND coalesce(quantity, 0) = 0 AND net IS NOT NULL AS cash FROM k3),
k5 AS (SELECT *, CASE WHEN cash THEN CASE WHEN n < 0 THEN 'cash_out' ELSE 'cash_in' END ELSE k END AS kind, CASE WHEN cash THEN NULL WHEN k IN ('sell', 'transfer_out') THEN -abs(quantity) WHEN k IN ('buy', 'reinvest', 'transfer_in') THEN abs(quantity) WHEN k IN ('dividend', 'return_of_capital', 'cash_in', 'cash_out') THEN NULL ELSE quantity END AS q, abs(gross) AS g,
  k = 'other' AND {HAS('whole', words.MARGIN)} AS margin, {HAS('label', words.DELIVERED, words.TAKEN)} AS off_market FROM k4),
k6 AS (SELECT *, list_filter([
  CASE WHEN trade_date IS NULL AND settle_date IS NOT NULL THEN {{'w': 'settlement_day', 'x': 0.0::DOUBLE}} END, CASE WHEN day IS NULL THEN {{'w': 'no_date', 'x': 0.25::DOUBLE}} END, CASE WHEN k = 'other' AND margin THEN {{'w': 'margin', 'x': 0.2::DOUBLE}} END, CASE WHEN k = 'other' AND NOT margin THEN {{'w': 'unknown_type', 'x': 0.2::DOUBLE}} END,
  CASE WHEN k = 'return_of_capital' THEN {{'w': 'return_of_capital', 'x': 0.0::DOUBLE}} END, CASE WHEN cash THEN {{'w': 'cash', 'x': -0.25::DOUBLE}} END, CASE WHEN nosec AND kind NOT IN ('cash_in', 'cash_out') THEN {{'w': 'no_security', 'x': 0.25::DOUBLE}} END,
  CASE WHEN kind IN ('buy', 'sell', 'reinvest') AND q IS NULL THEN {{'w': 'no_quantity', 'x': 0.25::DOUBLE}} END, CASE WHEN q * unit_price * g <> 0 AND abs(abs(q) * abs(unit_price) / divisor - g) > 1 + abs(q) * 0.5::DOUBLE / divisor THEN {{'w': 'row', 'x': 0.35::DOUBLE}} END,
  CASE WHEN abs(abs(abs(n) - g) - (coalesce(fee, 0) + coalesce(tax, 0))) > 1 THEN {{'w': 'net', 'x': 0.1::DOUBLE}} END], lambda x: x IS NOT NULL) AS ws FROM k5)"""
BLANK = f"""{FULL}, b AS (SELECT l_orderkey, l_linenumber, l_partkey, account_id AS file, (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS row_index, security_id AS name, trade_date, quantity::DOUBLE AS q, floor(gross / quantity) * divisor AS p, gross::DOUBLE AS g, (gross + fee)::DOUBLE AS net, divisor, account_id % 8 <> 7 AS typed,
  CASE WHEN tx_type <> 'sell' AND l_partkey % 3 = 0 THEN 'other' WHEN tx_type = 'sell' THEN 'sell' WHEN l_partkey % 5 = 0 THEN 'transfer_in' ELSE 'buy' END AS kind FROM rich),
c AS (SELECT *, kind = 'other' AND typed AND (SELECT bool_or(abs(q * p / v - g) <= 1 + (q * 0.5::DOUBLE + p) / v) FROM (VALUES (divisor::DOUBLE), (1::DOUBLE), (100::DOUBLE), (10000::DOUBLE)) t(v)) AS blank FROM b),
w AS (SELECT *, sum(CASE WHEN blank OR kind = 'sell' THEN -q WHEN kind = 'other' THEN 0 ELSE q END) OVER (PARTITION BY file, name ORDER BY trade_date, row_index ROWS UNBOUNDED PRECEDING) AS run FROM c),
nm AS (SELECT file, name, min(run) < 0 AS proven, count(*) FILTER (blank) AS n FROM w GROUP BY ALL HAVING count(*) FILTER (blank) > 0),
fl AS (SELECT file FROM nm GROUP BY file HAVING sum(CASE WHEN proven THEN n ELSE 0 END) >= 3)"""
CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace({}, '[(]\d{{1,6}}[)]', '', 'g'), '【[^【】]*】', '', 'g'), '<[^<>]*>', '', 'g'))"
TOKENS = r"list_filter(regexp_extract_all(regexp_replace(c, '[(][^()]*[)]', ' ', 'g'), '[A-Za-z0-9&+.\-]+'), lambda w: length(w) > 1)"
NAVS = f"{BASE}, navs AS (SELECT security_id AS ref, date, price AS nav FROM prices UNION ALL SELECT security_id, date - 9, price + 50 FROM prices)"
PENSIONS = f"""{NAVS}, pn AS (SELECT account_id, s.security_id, as_of_date, CASE WHEN (account_id + s.security_id) % 13 = 0 THEN 0 WHEN s.security_id % 3 = 0 THEN quantity ELSE 1 END AS quantity, CASE WHEN s.security_id % 8 <> 5 THEN (quantity * 1000 * price + account_id % 4 * 40000) // 10000 END AS value, CASE WHEN account_id % 6 <> 0 THEN trunc((quantity - 1000) * price / 10)::BIGINT END AS cost
  FROM snap s JOIN prices p ON p.security_id = s.security_id AND p.date = s.as_of_date)"""
MERGE = f"""{BASE}, sec AS (SELECT security_id, {', '.join(f'{TEXT(x)} AS {k}' for k, x in SECURITY.items())} FROM (SELECT s_suppkey AS security_id FROM supplier)),
pa AS (SELECT security_id AS source, {DOUBLE} AS target, (1000 - security_id % 1000) % 1000 AS rank FROM sec),
mp AS (SELECT p.*, CASE WHEN source = target THEN 'itself' WHEN t.security_id IS NULL THEN 'unknown' WHEN s.asset_class <> t.asset_class THEN 'asset_class' WHEN s.currency <> t.currency THEN 'currency' END AS conflict FROM pa p JOIN sec s ON s.security_id = source LEFT JOIN sec t ON t.security_id = target WHERE target IS NOT NULL),
m AS (SELECT source, target, rank FROM mp WHERE conflict IS NULL),
lo AS (SELECT account_id, security_id, CASE WHEN (account_id + month(as_of_date)) % 4 = 0 THEN 1 + account_id % 2 * 3 ELSE 0 END AS lot_seq, as_of_date, quantity FROM snap WHERE NOT (security_id % 20 = 1 AND account_id % 3 = 0)),
own AS (SELECT security_id AS target, account_id, max(lot_seq) AS top FROM lo WHERE security_id IN (SELECT target FROM m) GROUP BY ALL),
sl AS (SELECT target, account_id, source, rank, max(lot_seq) AS most, count(DISTINCT lot_seq) AS n, row_number() OVER (PARTITION BY target, account_id ORDER BY rank) AS k FROM lo JOIN m ON source = security_id GROUP BY target, account_id, source, rank)"""

SQL: dict[str, str] = {
    "ready_files": """WITH RECURSIVE l AS (SELECT 'f' || user_id AS name, date_diff('day', DATE '2024-01-01', ts::DATE) AS scan, least(count(*), 2) AS size FROM events GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY scan) AS n FROM l),
w AS (SELECT name, 0::BIGINT AS n, NULL::BIGINT AS scan, NULL::BIGINT AS waits, NULL::BIGINT AS done, false AS ready FROM o GROUP BY name
  UNION ALL SELECT name, n, scan, CASE WHEN d = size THEN q WHEN q = size THEN NULL ELSE size END, CASE WHEN q = size AND d IS DISTINCT FROM size THEN size ELSE d END, q IS NOT DISTINCT FROM size AND d IS DISTINCT FROM size FROM
    (SELECT o.*, CASE WHEN o.scan = w.scan + 1 THEN w.waits END AS q, CASE WHEN o.scan = w.scan + 1 THEN w.done END AS d FROM w JOIN o ON o.name = w.name AND o.n = w.n + 1))
SELECT w.name, w.scan, o.size, 7::BIGINT AS mtime FROM w JOIN o ON o.name = w.name AND o.n = w.n WHERE ready""",
    "accept_gate": f"""{FULL}, d AS (SELECT account_id::VARCHAR || '-' || trade_date::VARCHAR AS batch, 's' || (security_id % 5)::VARCHAR AS section, l_partkey, l_orderkey, account_id FROM rich),
p AS (SELECT batch, any_value(CASE WHEN account_id % 9 = 4 THEN false WHEN account_id % 2 = 0 THEN true END) AS ok FROM d GROUP BY batch), s AS (SELECT batch, section, CASE WHEN min(l_partkey) % 3 = 0 THEN NULL ELSE min(l_partkey) % 23 <> 1 END AS ok FROM d GROUP BY ALL),
q AS (SELECT batch, coalesce(string_agg(section, ',' ORDER BY section) FILTER (section <> 's4'), '') AS sections, string_agg(section, ',' ORDER BY section) FILTER (NOT ok) AS wrong FROM s GROUP BY batch),
c AS (SELECT batch, count(*) FILTER (l_partkey % 4 <> 0 AND l_orderkey % 3 = 2) AS excluded, count(*) FILTER (l_partkey % 4 = 0 AND l_orderkey % 3 <> 2) AS zeroed FROM d WHERE section <> 's4' GROUP BY batch),
x AS (SELECT p.batch, list_filter([CASE WHEN sections = '' THEN 'nothing to include' END, CASE WHEN NOT coalesce(ok, true) THEN 'total' END, CASE WHEN wrong IS NOT NULL THEN 'sections ' || wrong END], lambda y: y IS NOT NULL) AS reasons, sections, coalesce(excluded, 0) AS excluded, coalesce(zeroed, 0) AS zeroed FROM p JOIN q USING (batch) LEFT JOIN c USING (batch))
SELECT batch, len(reasons) = 0 AS accepted, array_to_string(reasons, '; ') AS reasons, sections, excluded, zeroed FROM x""",
    "nav_verified": f"""{NAVS}, d AS (SELECT security_id::VARCHAR || '-' || date::VARCHAR AS id, date + (security_id % 12)::INTEGER AS as_of, price + CASE security_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 50 ELSE 0 END AS reported, unnest([security_id, security_id + 1]) AS ref FROM prices)
SELECT id, d.ref, coalesce(bool_or(nav = reported), false) AS matched, max(CASE WHEN nav = reported THEN n.date END) AS matched_on, arg_max(nav, n.date) AS latest FROM d LEFT JOIN navs n ON n.ref = d.ref AND n.date BETWEEN as_of - 7 AND as_of GROUP BY id, d.ref""",
    "nav_movements": f"""{PENSIONS}, w AS (SELECT *, lead(as_of_date) OVER x AS t2, lead(value) OVER x AS v2, lead(cost) OVER x AS c2 FROM pn WHERE quantity <> 0 AND value IS NOT NULL WINDOW x AS (PARTITION BY account_id, security_id ORDER BY as_of_date)),
p AS (SELECT security_id, as_of_date AS t1, value AS v1, t2, v2, c2 - cost AS paid, row_number() OVER (PARTITION BY security_id ORDER BY t2 DESC, account_id DESC) AS k FROM w WHERE t2 IS NOT NULL AND cost IS NOT NULL AND c2 IS NOT NULL QUALIFY k <= 6),
c AS (SELECT *, unnest([security_id, security_id + 1]) AS ref FROM p),
e AS (SELECT c.security_id, c.ref, k, min(abs(v1::DOUBLE * b.nav / a.nav + paid - v2)) AS err, any_value(v2) AS v2 FROM c LEFT JOIN navs a ON a.ref = c.ref AND a.date BETWEEN t1 - 14 AND t1 LEFT JOIN navs b ON b.ref = c.ref AND b.date BETWEEN t2 - 14 AND t2 AND a.nav IS NOT NULL GROUP BY c.security_id, c.ref, k),
g AS (SELECT security_id, ref, count(err) FILTER (v2 <> 0) AS checked, count(*) FILTER (v2 <> 0 AND err <= greatest(v2 * 0.005::DOUBLE, 10)) AS passed, max(CASE WHEN v2 <> 0 THEN err / greatest(v2 * 0.005::DOUBLE, 10) END) AS worst FROM e GROUP BY ALL)
SELECT security_id, ref, CASE WHEN checked > 0 THEN checked = passed END AS explained, checked, {r('worst', 3)} AS worst FROM g""",
    "pension_units": f"""{PENSIONS}, s AS (SELECT account_id, security_id, 0 AS lot_seq, as_of_date + (security_id % 20)::INTEGER AS as_of, security_id AS ref, quantity, value FROM pn), mn AS (SELECT security_id, date, price * 77 // 10 AS v FROM prices WHERE month(date) % 4 = 0),
v AS (SELECT s.*, coalesce(s.value, mn.v) AS val FROM s ASOF LEFT JOIN mn ON mn.security_id = s.security_id AND s.as_of >= mn.date), l AS (SELECT v.*, n.date AS last FROM v ASOF LEFT JOIN navs n ON n.ref = v.ref AND v.as_of >= n.date),
u AS (SELECT l.account_id, l.security_id, l.as_of, arg_max(nav, n.date) AS newest, arg_max(CASE WHEN t >= 1 AND abs(t * nav - val * 10000) < 1000000 THEN t END, CASE WHEN t >= 1 AND abs(t * nav - val * 10000) < 1000000 THEN n.date END) AS whole FROM l JOIN (SELECT * FROM navs WHERE nav > 0) n ON n.ref = l.ref AND n.date BETWEEN last - 14 AND last, LATERAL (SELECT (2 * val * 10000 + nav) // (2 * nav) AS t) WHERE val > 0 GROUP BY ALL),
z AS (SELECT l.*, whole, coalesce(whole::DOUBLE, round_even(val * 10000::DOUBLE / newest, 4)) AS units, newest FROM l LEFT JOIN u USING (account_id, security_id, as_of)),
y AS (SELECT *, coalesce(quantity <> 0 AND units IS NOT NULL AND (quantity <= 1 OR (whole IS NOT NULL AND units <> quantity)), false) AS changed FROM z)
SELECT account_id, security_id, lot_seq, as_of, ref, {r('CASE WHEN changed THEN units ELSE quantity END')} AS quantity, value, changed, CASE WHEN changed THEN whole IS NOT NULL END AS exact FROM y""",
    "merge_conflicts": f"{MERGE} SELECT source, target, conflict FROM mp WHERE conflict IS NOT NULL",
    "merged_lots": f"""{MERGE.replace('WITH ', 'WITH RECURSIVE ', 1)}, tp AS (SELECT target, account_id, 0::BIGINT AS k, top::INTEGER AS before, top::INTEGER AS top FROM (SELECT DISTINCT target, account_id FROM sl) LEFT JOIN own USING (target, account_id)
  UNION ALL SELECT t.target, t.account_id, s.k, t.top, CASE WHEN t.top IS NULL THEN most ELSE greatest(t.top, most) + n END::INTEGER FROM tp t JOIN sl s ON s.target = t.target AND s.account_id = t.account_id AND s.k = t.k + 1),
nw AS (SELECT l.*, m.target, CASE WHEN m.target IS NULL OR tp.before IS NULL THEN lot_seq ELSE greatest(tp.before, sl.most) + dense_rank() OVER (PARTITION BY l.security_id, l.account_id ORDER BY lot_seq) END AS new_seq FROM lo l LEFT JOIN m ON m.source = l.security_id LEFT JOIN sl ON sl.source = l.security_id AND sl.account_id = l.account_id LEFT JOIN tp ON tp.target = sl.target AND tp.account_id = sl.account_id AND tp.k = sl.k)
SELECT account_id, coalesce(target, security_id) AS security_id, new_seq::INTEGER AS lot_seq, count(*) AS n, sum(quantity)::BIGINT AS quantity, count(DISTINCT as_of_date) AS days FROM nw GROUP BY ALL""",
    "merged_securities": f"""{MERGE}, al AS (SELECT 'a' || (security_id % 70)::VARCHAR AS alias, min(security_id) AS security_id FROM sec GROUP BY 1),
an AS (SELECT alias, coalesce(target, security_id) AS security_id, coalesce(rank, -1) AS k, 0 AS new FROM al LEFT JOIN m ON source = security_id UNION ALL SELECT name_key, target, rank, 1 FROM sec JOIN m ON source = security_id WHERE name_key <> '' UNION ALL SELECT name_key, security_id, max(rank), 1 FROM sec JOIN m ON target = security_id WHERE name_key <> '' GROUP BY ALL),
ac AS (SELECT security_id, count(*) AS aliases FROM (SELECT alias, arg_max(security_id, (new, k, security_id)) AS security_id FROM an GROUP BY alias) GROUP BY 1),
gv AS (SELECT target, arg_min(code, rank) FILTER (code IS NOT NULL) AS code, arg_min(price_status, rank) FILTER (price_status <> 'unlinked') AS ps, arg_min(price_ref, rank) FILTER (price_status <> 'unlinked') AS pr FROM sec JOIN m ON source = security_id GROUP BY 1)
SELECT security_id, coalesce(sec.code, gv.code) AS code, CASE WHEN price_status = 'unlinked' AND ps IS NOT NULL THEN ps ELSE price_status END AS price_status, CASE WHEN price_status = 'unlinked' AND ps IS NOT NULL THEN pr ELSE price_ref END AS price_ref, coalesce(aliases, 0) AS aliases FROM sec LEFT JOIN gv ON target = security_id LEFT JOIN ac USING (security_id) WHERE security_id NOT IN (SELECT source FROM m)""",
    "merged_tags": f"""{MERGE}, tg AS (SELECT security_id, unnest(range(1, security_id % 4 + 2)) AS tag_id FROM sec), t AS (SELECT coalesce(target, security_id) AS security_id, tag_id, security_id % 9 * 10 + tag_id AS weight, coalesce(rank, -1) AS k FROM tg LEFT JOIN m ON source = security_id)
SELECT security_id, tag_id, arg_min(weight, (k, weight)) AS weight FROM t GROUP BY ALL""",
    "rows_to_transactions": f"""{ROWS} SELECT l_orderkey, l_linenumber, l_partkey, kind, day AS trade_date, q AS quantity, g AS gross, n AS net, {r("CASE WHEN k = 'split' AND coalesce(unit_price, 0) <> 0 THEN CASE price_text WHEN '1:3' THEN 3 ELSE 2 END END")} AS split_ratio, margin, off_market,
  array_to_string(list_transform(ws, lambda x: x.w), ',') AS warnings, {r('greatest(0, least(1, 0.9::DOUBLE - coalesce(list_sum(list_transform(ws, lambda x: x.x)), 0)))', 2)} AS confidence FROM k6""",
    "blank_type_inference": f"""{BLANK} SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN blank AND fl.file IS NOT NULL THEN 'buy' ELSE kind END AS kind, q AS quantity, CASE WHEN blank AND fl.file IS NOT NULL THEN -net ELSE net END AS net, CASE WHEN blank AND fl.file IS NOT NULL THEN CASE WHEN proven THEN 'balance' ELSE 'file' END END AS inferred,
  CASE WHEN blank AND fl.file IS NOT NULL THEN 'inferred' WHEN kind = 'other' THEN 'unknown_type' ELSE '' END AS warnings, CASE WHEN kind = 'other' AND NOT (blank AND fl.file IS NOT NULL) THEN 0.7::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM c LEFT JOIN nm ON nm.file = c.file AND nm.name = c.name LEFT JOIN fl ON fl.file = c.file""",
    "fund_search_words": f"""WITH d AS (SELECT p_partkey, p_name, {DECORATED} AS name FROM part), e AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 2 THEN p_name WHEN 4 THEN name ELSE {CLEAN.format('name')} END AS c FROM d), t AS (SELECT *, {TOKENS} AS w FROM e),
o AS (SELECT *, list_transform(list_sort(list_transform(w, lambda x, i: {{'l': -length(x), 'i': i}})), lambda y: w[y.i]) AS byl FROM t)
SELECT p_partkey, c AS cleaned, array_to_string(list_transform(list_filter(list_transform(all_, lambda x, i: {{'x': x, 'f': list_position(all_, x) = i}}), lambda y: y.f), lambda y: y.x), '|') AS searches FROM (SELECT *, list_concat([array_to_string(w[1:5], ' ')], CASE WHEN len(w) > 2 THEN [array_to_string(w[1:2], ' ')] ELSE [] END, CASE WHEN len(w) > 1 THEN w[1:1] ELSE [] END, list_filter(byl[1:2], lambda x: length(x) > 2), CASE WHEN length(byl[1]) > 3 THEN [left(byl[1], 3)] ELSE [] END) AS all_ FROM o)""",
    "link_suggestions": f"""{PENSIONS}, cd AS (SELECT s_suppkey AS security_id, unnest([s_suppkey, s_suppkey + 1, s_suppkey + 2, s_suppkey + 3]) AS ref FROM supplier),
w AS (SELECT *, lead(as_of_date) OVER x AS t2, lead(value) OVER x AS v2, lead(cost) OVER x AS c2 FROM pn WHERE quantity <> 0 AND value IS NOT NULL WINDOW x AS (PARTITION BY account_id, security_id ORDER BY as_of_date)),
p AS (SELECT security_id, as_of_date AS t1, value AS v1, t2, v2, c2 - cost AS paid, row_number() OVER (PARTITION BY security_id ORDER BY t2 DESC, account_id DESC) AS k FROM w WHERE t2 IS NOT NULL AND cost IS NOT NULL AND c2 IS NOT NULL QUALIFY k <= 6),
e AS (SELECT c.security_id, c.ref, k, min(abs(v1::DOUBLE * b.nav / a.nav + paid - v2)) AS err, any_value(v2) AS v2 FROM p JOIN cd c ON c.security_id = p.security_id LEFT JOIN navs a ON a.ref = c.ref AND a.date BETWEEN t1 - 14 AND t1 LEFT JOIN navs b ON b.ref = c.ref AND b.date BETWEEN t2 - 14 AND t2 AND a.nav IS NOT NULL GROUP BY c.security_id, c.ref, k),
mv AS (SELECT security_id, ref, count(err) FILTER (v2 <> 0) > 0 AND count(err) FILTER (v2 <> 0) = count(*) FILTER (v2 <> 0 AND err <= greatest(v2 * 0.005::DOUBLE, 10)) AS moved FROM e GROUP BY ALL),
la AS (SELECT security_id, max(date) + 3 AS as_of, arg_max(price, date) + CASE security_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 50 ELSE 0 END AS reported FROM prices GROUP BY 1),
ma AS (SELECT cd.security_id, cd.ref, coalesce(bool_or(nav = reported), false) AS hit FROM cd JOIN la USING (security_id) LEFT JOIN navs n ON n.ref = cd.ref AND n.date BETWEEN as_of - 7 AND as_of GROUP BY ALL),
c AS (SELECT cd.*, (security_id * 7 + ref * 13) % 10 / 10.0::DOUBLE AS score, (security_id + ref) % 9 = 0 AS unread, coalesce(hit, false) AS hit, coalesce(moved, false) AS moved FROM cd LEFT JOIN ma USING (security_id, ref) LEFT JOIN mv USING (security_id, ref) QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY score DESC, ref) <= 3),
g AS (SELECT security_id, count(*) FILTER (hit) AS n, max(score) FILTER (hit) AS s, arg_min(ref, (-score, ref)) FILTER (hit) AS ref, count(*) FILTER (score >= 0.35 OR moved) AS v, bool_or(unread) AS unread, string_agg(ref::VARCHAR, ',' ORDER BY NOT hit, NOT moved, -score, ref) AS every, string_agg(ref::VARCHAR, ',' ORDER BY NOT hit, NOT moved, -score, ref) FILTER (score >= 0.35 OR moved) AS likely FROM c GROUP BY 1)
SELECT security_id, CASE WHEN n = 1 AND s >= 0.2 THEN 'auto' WHEN n > 1 OR v > 0 THEN 'candidates' ELSE 'none' END AS status, CASE WHEN n = 1 AND s >= 0.2 THEN 'price' WHEN n > 1 THEN 'several prices' WHEN unread THEN 'prices unread' ELSE 'no price' END AS reason, CASE WHEN n = 1 AND s >= 0.2 THEN ref END AS best_ref, CASE WHEN (n = 1 AND s >= 0.2) OR n > 1 OR v = 0 THEN every ELSE likely END AS shown FROM g""",
}
