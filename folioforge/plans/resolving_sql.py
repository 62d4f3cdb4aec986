"""DuckDB SQL for the queries of resolving.py."""

from __future__ import annotations

from ..operators import statements
from .ledgers_sql import BOTH, G
from .oracle import BASE, LEDGER, PRICES, SNAP, r
from .resolving import ACQUIRED, APPRAISED, CANDIDATE, CHOICE, FETCH, FETCH_DAY, HOLDING, INDEX, LOT_ROW, NAMED, NOW, SERIES_REF, SOLD, SOURCE, SPOT, TODAY, TWIN
from .wealth_sql import COLUMNS, INS

TEXT = lambda x: x.replace("STRING", "VARCHAR")
RICH = f"WITH {LEDGER}, rich AS (SELECT *, {COLUMNS} FROM ledger)"
#: The forms of a code.
KEYS = "list_distinct(list_filter([nullif(trim({0}), ''), CASE WHEN regexp_matches(trim({0}), '^0[0-9]{{4}}0000$') THEN substr(trim({0}), 2, 4) END, CASE WHEN regexp_matches({0}, '^[0-9][0-9A-Z]{{3}}0$') THEN substr({0}, 1, 4) WHEN regexp_matches({0}, '^[0-9][0-9A-Z]{{3}}$') THEN {0} END], lambda x: x IS NOT NULL))".format
LINKED = f"""{RICH}, {PRICES},
lr AS (SELECT security_id, {INDEX} AS row_index, last_day(trade_date) AS day, {', '.join(f'{TEXT(v)} AS {k}' for k, v in NAMED.items())} FROM rich JOIN (SELECT security_id, date AS last, price FROM prices) USING (security_id) WHERE last = last_day(trade_date)),
op AS (SELECT * FROM lr WHERE known IS NULL AND type NOT IN ('cash_in', 'cash_out') AND NOT margin),
en AS (SELECT name, any_value(security_id) AS s, count(*) AS rows, count(*) FILTER (type = 'other') AS undetermined, coalesce(sum(signed) FILTER (type <> 'other'), 0)::DOUBLE AS net, min(day) AS first_date, max(day) AS last_date FROM op WHERE NOT still GROUP BY name),
nk AS (SELECT DISTINCT name, unnest({KEYS('code')}) AS key FROM op WHERE name IN (SELECT name FROM en)),
mb AS (SELECT en.*, CASE WHEN name IN (SELECT name FROM nk) THEN 'c' || s ELSE name END AS comp FROM en),
gr AS (SELECT comp, (list(name ORDER BY last_date DESC, name))[1] AS "group", any_value(s) AS s, count(*) AS names, sum(rows)::BIGINT AS rows, sum(undetermined)::BIGINT AS undetermined, sum(net) AS net_quantity, min(first_date) AS first_date, max(last_date) AS last_date FROM mb GROUP BY comp),
ms AS (SELECT name, "group" FROM mb JOIN gr USING (comp)),
ok AS (SELECT DISTINCT "group", key FROM nk JOIN ms USING (name)),
rk AS (SELECT key, arg_min(known, (row_index, known)) AS known FROM (SELECT unnest({KEYS('code')}) AS key, known, row_index FROM lr WHERE known IS NOT NULL AND type NOT IN ('cash_in', 'cash_out')) GROUP BY key),
se AS (SELECT security_id + w AS c, date + CASE WHEN security_id % 8 = 3 THEN 2 ELSE 0 END AS date, price FROM prices, (VALUES (0), ({TWIN})) t(w) WHERE security_id % 9 <> 4),
ca AS (SELECT "group", s, c, {', '.join(f'{TEXT(v)} AS {k}' for k, v in CANDIDATE.items())} FROM (SELECT "group", s, unnest(CASE WHEN s % 3 = 2 THEN [s + 7 + {TWIN * 2}] WHEN s % 6 = 0 THEN [s, s + 1, s + {TWIN}] ELSE [s, s + 1] END) AS c FROM gr)),
mp AS (SELECT "group", day, at_price AS u, row_index FROM op JOIN ms USING (name) WHERE NOT still AND NOT off_market AND type NOT IN ('transfer_in', 'transfer_out', 'dividend', 'return_of_capital', 'split') AND at_price <> 0),
nr AS (SELECT ca."group", c, row_index, u, max(price) FILTER (se.date = day) AS same, arg_min(price, se.date) FILTER (se.date > day) AS nxt FROM ca JOIN mp USING ("group") JOIN se USING (c) WHERE se.date BETWEEN day AND day + 4 GROUP BY ALL),
wt AS (SELECT "group", c, count(*) AS checked, count(*) FILTER (coalesce(abs(same - u) <= 1, false) OR coalesce(abs(nxt - u) <= 1, false)) AS matched, bool_or(NOT coalesce(abs(same - u) <= 1, false) AND coalesce(abs(nxt - u) <= 1, false)) AS shifted FROM nr GROUP BY ALL),
cw AS (SELECT ca.*, coalesce(checked, 0) AS checked, coalesce(matched, 0) AS matched, coalesce(shifted, false) AS shifted FROM ca LEFT JOIN wt USING ("group", c)),
su AS (SELECT "group", count(*) AS sure, min(c) AS one, count(*) FILTER (held) AS here, min(c) FILTER (held) AS one_here FROM (SELECT *, c IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 12 = 6) AS held FROM cw WHERE matched >= 3 AND (matched = checked OR (checked >= 20 AND matched >= 0.9::DOUBLE * checked))) GROUP BY 1),
co AS (SELECT "group", min(known) AS by_code FROM ok JOIN rk USING (key) GROUP BY 1 HAVING min(known) = max(known)),
d0 AS (SELECT gr.*, CASE WHEN by_code IS NOT NULL THEN 'code' WHEN sure = 1 THEN 'price' WHEN sure > 1 AND here = 1 THEN 'account' WHEN sure > 1 THEN 'ambiguous' ELSE 'none' END AS how, coalesce(by_code, CASE WHEN sure = 1 THEN one WHEN sure > 1 AND here = 1 THEN one_here END) AS sid FROM gr LEFT JOIN co USING ("group") LEFT JOIN su USING ("group")),
al AS (SELECT security_id AS s, sum(signed)::DOUBLE AS q FROM op WHERE security_id % 4 = 1 AND NOT still AND type <> 'other' AND NOT ends_with(name, 'old') GROUP BY 1),
ho AS (SELECT s + {TWIN * 3} AS h, q FROM al UNION ALL SELECT s + {TWIN * 4}, q FROM al WHERE s % 16 = 1),
h1 AS (SELECT q, min(h) AS h FROM ho WHERE h NOT IN (SELECT known FROM lr WHERE known IS NOT NULL UNION SELECT sid FROM d0 WHERE sid IS NOT NULL) GROUP BY q HAVING count(*) = 1),
g1 AS (SELECT net_quantity AS q, min("group") AS "group" FROM d0 WHERE sid IS NULL AND undetermined = 0 AND net_quantity > 0 GROUP BY 1 HAVING count(*) = 1),
li AS (SELECT d0.* REPLACE (CASE WHEN h IS NOT NULL THEN 'quantity' ELSE how END AS how, coalesce(sid, h) AS sid) FROM d0 LEFT JOIN (SELECT "group", h FROM g1 JOIN h1 USING (q)) USING ("group")),
sk AS (SELECT DISTINCT * FROM (SELECT known AS c, key FROM rk UNION ALL SELECT sid, key FROM ok JOIN li USING ("group") WHERE sid IS NOT NULL UNION ALL SELECT c, unnest({KEYS('code')}) FROM ca)),
cv AS (SELECT *, CASE WHEN checked = 0 THEN 'unknown' WHEN matched = checked THEN 'match' WHEN matched > 0 THEN 'partial' ELSE 'mismatch' END AS verdict,
  CASE group_comparable WHEN '国内株式' THEN comparable IN ('x債券', '先進国株式', 'バランス株式') AND NOT (comparable = 'バランス株式') ELSE comparable IN ('x債券', '国内株式') END AS clash,
  "group" IN (SELECT "group" FROM ok) AND "group" NOT IN (SELECT "group" FROM li WHERE sid IS NOT NULL) AND c IN (SELECT c FROM sk) AND NOT EXISTS (SELECT 1 FROM ok JOIN sk USING (key) WHERE ok."group" = cw."group" AND sk.c = cw.c) AS apart FROM cw),
lv AS (SELECT *, CASE WHEN verdict = 'mismatch' THEN 'price' WHEN checked = 0 AND clash THEN 'category' WHEN checked = 0 AND refined < 0.5 THEN 'name' WHEN checked = 0 AND apart THEN 'code' END AS against FROM cv)"""
NAME_OF = "regexp_replace(regexp_replace(lower({}), '\\s*\\([0-9]+\\)\\s*$', ''), '[\\s·・]+', '', 'g')".format
SECTION = lambda i: "CASE section " + " ".join(f"WHEN '{s}' THEN {repr(v[i])}" for s, v in statements.SECTIONS.items()) + " END"
FETCHING = f"""WITH {LEDGER}, sp AS (SELECT s_suppkey AS security_id FROM supplier),
cv AS (SELECT {FETCH} AS source, security_id::VARCHAR AS ref, trade_date AS s, trade_date + (quantity % 30)::INTEGER AS e FROM ledger WHERE account_id % 5 = 0),
wa AS (SELECT {FETCH} AS source, security_id::VARCHAR AS ref, unnest([{{'s': DATE '1994-01-01', 'e': DATE '1995-12-31'}}, {{'s': DATE '1997-02-01', 'e': DATE '1997-12-31'}}]) AS w FROM sp),
tr AS (SELECT {FETCH} AS source, security_id::VARCHAR AS ref, DATE '{FETCH_DAY}' - CASE WHEN security_id % 5 = 2 THEN 1 ELSE 0 END AS attempted_on, security_id % 5 = 1 AS ok FROM sp WHERE security_id % 5 <> 4),
wd AS (SELECT source, ref, w.s AS lo, unnest(generate_series(w.s, w.e, INTERVAL 1 DAY))::DATE AS day FROM wa), cd AS (SELECT DISTINCT source, ref, unnest(generate_series(s, e, INTERVAL 1 DAY))::DATE AS day FROM cv),
md AS (SELECT source, ref, lo, day, day - row_number() OVER (PARTITION BY source, ref, lo ORDER BY day)::INTEGER AS island FROM wd ANTI JOIN cd USING (source, ref, day)),
ga AS (SELECT source, ref, min(day) AS gap_start, max(day) AS gap_end FROM md GROUP BY source, ref, lo, island),
pa AS (SELECT * FROM ga ANTI JOIN (SELECT source, ref FROM tr WHERE attempted_on = DATE '{FETCH_DAY}' AND (NOT ok OR source = 'fund')) USING (source, ref)),
pl AS (SELECT * FROM pa WHERE source <> 'fund' UNION ALL SELECT source, ref, min(gap_start), max(gap_end) FROM pa WHERE source = 'fund' GROUP BY source, ref),
re AS (SELECT source, ref, gap_start AS s, CASE WHEN day(gap_start) % 3 = 0 THEN gap_end ELSE gap_start + ((gap_end - gap_start) // 2)::INTEGER END AS e FROM pl WHERE day(gap_start) % 3 <> 2 AND ref::BIGINT % 7 <> 1)"""
SECTIONS = f"""{RICH}, d AS (SELECT account_id::VARCHAR || '-' || date_trunc('month', trade_date)::DATE::VARCHAR AS batch, 's' || (security_id % 5)::VARCHAR AS section, CASE WHEN l_partkey % 23 <> 0 THEN gross END AS value, gross, l_partkey FROM rich),
st AS (SELECT batch, section, CASE WHEN min(l_partkey) % 4 <> 3 THEN sum(gross) END::BIGINT AS expected FROM d WHERE section <> 's4' GROUP BY ALL),
sa AS (SELECT * FROM st UNION ALL SELECT batch, 'empty', 0 FROM st WHERE section = 's0'), rw AS (SELECT batch, section, count(*) AS rows, sum(value)::BIGINT AS computed FROM d GROUP BY ALL),
ss AS (SELECT batch, section, coalesce(rows, 0) AS rows, CASE WHEN rows IS NULL THEN 0 ELSE computed END::BIGINT AS computed, expected, CASE WHEN expected IS NOT NULL THEN coalesce((CASE WHEN rows IS NULL THEN 0 ELSE computed END) = expected, false) END AS ok FROM sa FULL JOIN rw USING (batch, section))"""
SPOTS = f"""{BASE}, sx AS (SELECT *, {TEXT(SOURCE)} AS source, {TEXT(SERIES_REF)} AS ref FROM prices), la AS (SELECT security_id, arg_max(price, date) AS price, any_value(source) AS source, any_value(ref) AS ref FROM sx GROUP BY 1),
da AS (SELECT source, ref, date, price, CASE WHEN security_id % 13 = 0 THEN 'USD' END AS currency FROM sx WHERE source NOT IN ('none', 'metal') AND security_id % 7 <> 3 UNION ALL SELECT 'manual', security_id::VARCHAR, date, price, CASE WHEN security_id % 13 = 0 THEN 'USD' END FROM sx WHERE security_id % 5 = 0),
ld AS (SELECT source, ref, arg_max(price, date)::DOUBLE AS price, coalesce(any_value(currency), 'JPY') AS currency FROM da GROUP BY ALL),
aq AS (SELECT * FROM la WHERE source IN ('coin', 'equity') AND ref IS NOT NULL),
fr AS (SELECT source, ref, price + 1 AS price FROM aq WHERE security_id % 4 = 0 AND {NOW} - security_id % 100 * 10 <= 300),
qu AS (SELECT source, ref, (price + 2)::DOUBLE AS price, CASE WHEN security_id % 4 = 2 THEN 'USD' ELSE 'JPY' END AS currency FROM aq WHERE security_id % 4 <> 1 AND security_id % 8 <> 2
  UNION ALL SELECT 'metal', m, f.price * u.price / 31.1034768::DOUBLE, 'JPY' FROM (VALUES ('M0', 1), ('M2', 2)) t(m, i) JOIN la f ON f.security_id = i JOIN la u ON u.security_id = 3 WHERE m IN (SELECT ref FROM la WHERE source = 'metal')),
keys AS (SELECT source, ref FROM da UNION SELECT source, ref FROM aq WHERE security_id % 4 <> 1 UNION SELECT source, ref FROM qu),
sp AS (SELECT k.source, k.ref, CASE WHEN k.source IN ('fund', 'manual') THEN ld.price WHEN fr.price IS NOT NULL THEN fr.price WHEN qu.price IS NOT NULL THEN qu.price ELSE ld.price END AS price, CASE WHEN k.source IN ('fund', 'manual') THEN ld.currency WHEN fr.price IS NOT NULL THEN 'JPY' WHEN qu.price IS NOT NULL THEN qu.currency ELSE ld.currency END AS price_currency,
  CASE WHEN k.source IN ('fund', 'manual') THEN CASE WHEN ld.price IS NOT NULL THEN 'stored' END WHEN fr.price IS NOT NULL THEN 'cache' WHEN qu.price IS NOT NULL THEN 'quote' WHEN ld.price IS NOT NULL THEN 'fallback' END AS origin
  FROM keys k LEFT JOIN ld ON ld.source = k.source AND ld.ref = k.ref LEFT JOIN fr ON fr.source = k.source AND fr.ref = k.ref LEFT JOIN qu ON qu.source = k.source AND qu.ref = k.ref),
ap AS (SELECT security_id, 'X' || security_id % 4 AS x, date, price::DOUBLE AS price FROM prices WHERE security_id % 5 = 0 AND {APPRAISED}),
ab AS (SELECT security_id, x, max(date) FILTER (date <= DATE '{TODAY}') AS ad, arg_max(price, date) FILTER (date <= DATE '{TODAY}') AS av, min(date) FILTER (date > DATE '{TODAY}') AS bd, arg_min(price, date) FILTER (date > DATE '{TODAY}') AS bv FROM ap GROUP BY ALL),
ix AS (SELECT 'X' || security_id AS x, date, price::DOUBLE AS level FROM prices WHERE security_id IN (1, 2, 3) AND month(date) IN (3, 6, 9)),
dy AS (SELECT x, DATE '{TODAY}' AS day FROM ab UNION SELECT x, ad FROM ab WHERE ad IS NOT NULL UNION SELECT x, bd FROM ab WHERE bd IS NOT NULL),
lv AS (SELECT x, day, CASE WHEN d1 IS NULL THEN l0 WHEN d0 IS NULL THEN NULL ELSE l0 + (l1 - l0) * ((day - d0)::DOUBLE / (d1 - d0)) END AS level FROM (SELECT dy.x, day, max(date) FILTER (date <= day) AS d0, arg_max(level, date) FILTER (date <= day) AS l0, min(date) FILTER (date > day) AS d1, arg_min(level, date) FILTER (date > day) AS l1 FROM dy LEFT JOIN ix USING (x) GROUP BY ALL)),
ex AS (SELECT security_id, CASE WHEN av IS NULL THEN CASE WHEN u.level IS NOT NULL AND b.level IS NOT NULL THEN bv * u.level / b.level ELSE bv END WHEN bv IS NULL THEN CASE WHEN u.level IS NOT NULL AND a.level IS NOT NULL THEN av * u.level / a.level ELSE av END
  WHEN u.level IS NOT NULL AND a.level IS NOT NULL AND b.level IS NOT NULL THEN av * u.level / a.level + (bv - av * b.level / a.level) * ((DATE '{TODAY}' - ad)::DOUBLE / (bd - ad)) ELSE av + (bv - av) * ((DATE '{TODAY}' - ad)::DOUBLE / (bd - ad)) END AS value,
  u.level IS NOT NULL AND (av IS NULL OR a.level IS NOT NULL) AND (bv IS NULL OR b.level IS NOT NULL) AS indexed
  FROM ab LEFT JOIN lv u ON u.x = ab.x AND u.day = DATE '{TODAY}' LEFT JOIN lv a ON a.x = ab.x AND a.day = ad LEFT JOIN lv b ON b.x = ab.x AND b.day = bd),
{INS}, se AS (SELECT security_id, currency, status = 'manual' AS hand, CASE WHEN status = 'manual' THEN 'manual' ELSE source END AS source, CASE WHEN status = 'manual' THEN security_id::VARCHAR ELSE ref END AS ref FROM (SELECT security_id, currency, {', '.join(f'{TEXT(v)} AS {k}' for k, v in SPOT.items())} FROM (SELECT security_id, currency FROM ins)) WHERE NOT inactive AND (status = 'manual' OR (status = 'linked' AND source <> 'none' AND ref <> '')))"""

TARGETS = f"""WITH h AS (SELECT p_partkey AS ref, p_name AS name, {', '.join(f"{TEXT(v).replace('0.2D', '0.2::DOUBLE').replace('1.0D', '1.0::DOUBLE')} AS {k}" for k, v in HOLDING.items())} FROM part),
t AS (SELECT *, CASE WHEN section = 'stock' AND regexp_matches(code, '^[0-9]{{4}}0?$') THEN substr(code, 1, 4) END AS c, CASE section WHEN 'deposit' THEN '{statements.CASH_NAME}' WHEN 'crypto' THEN '{statements.COIN_NAME}' ELSE name END AS n, section <> 'pension' AND trim(coalesce(institution, '')) = '' AS nameless FROM h WHERE section <> 'loan')
SELECT ref, section, CASE WHEN section = 'pension' THEN '{statements.PENSION_ACCOUNT}' ELSE institution END AS account, n AS name, {NAME_OF('n')} AS name_key, c AS code, {SECTION(0)} AS asset_class, {SECTION(1)} AS unit, {SECTION(2)} AS divisor, CASE WHEN c IS NULL THEN 'none' ELSE 'series' END AS source, c || '.T' AS source_ref,
  CASE WHEN c IS NOT NULL THEN 'linked' WHEN section IN ('stock', 'fund') THEN 'unlinked' ELSE 'not required' END AS status, CASE WHEN section IN ('deposit', 'crypto') THEN name WHEN section = 'point' THEN concat_ws('|', coalesce(nullif(point_type, ''), name), nullif(expiry, '')) END AS lot_label,
  CASE WHEN section IN ('deposit', 'crypto') THEN value WHEN section = 'pension' THEN 1 ELSE quantity END::DOUBLE AS quantity, CASE WHEN section IN ('stock', 'fund', 'pension') THEN avg_cost END::BIGINT AS avg_cost, CASE WHEN section IN ('stock', 'fund') THEN price END::BIGINT AS reported_price, value::BIGINT AS reported_value, CASE WHEN nameless THEN least(confidence, 0.4::DOUBLE) ELSE confidence END AS confidence, nameless AS no_account FROM t"""
ENSURED = f"""WITH tg AS ({TARGETS}), t0 AS (SELECT *, ref % 11 * 10 + ref % 10 AS batch, CASE WHEN ref % 17 = 0 THEN ref END AS choice FROM tg),
ac AS (SELECT account AS name, min(ref) AS account_id FROM t0 WHERE trim(account) <> '' GROUP BY 1 HAVING min(ref) % 2 = 0),
se AS (SELECT ref AS security_id, code, name_key FROM t0 WHERE ref % 3 = 1 AND section IN ('stock', 'fund', 'point')),
ali AS (SELECT name_key AS alias, min(ref) AS s FROM t0 WHERE ref % 10 = 1 GROUP BY 1), bc AS (SELECT code, min(security_id) AS s FROM se WHERE code IS NOT NULL GROUP BY 1), bn AS (SELECT name_key, min(security_id) AS s FROM se GROUP BY 1),
ok AS (SELECT * FROM t0 WHERE batch NOT IN (SELECT batch FROM t0 WHERE trim(coalesce(account, '')) = '')),
na AS (SELECT account, row_number() OVER (ORDER BY account) + (SELECT max(account_id) FROM ac) AS account_id FROM (SELECT DISTINCT account FROM ok WHERE account NOT IN (SELECT name FROM ac))),
kn AS (SELECT ok.*, coalesce(se.security_id, bc.s, ali.s, bn.s) AS known, coalesce(nullif(ok.code, ''), ok.name_key) AS ident FROM ok LEFT JOIN se ON se.security_id = choice LEFT JOIN bc ON bc.code = ok.code LEFT JOIN ali ON alias = ok.name_key LEFT JOIN bn ON bn.name_key = ok.name_key),
fi AS (SELECT ident, arg_min(known, (batch, ref)) FILTER (known IS NOT NULL) AS known_security, arg_min(ref, (batch, ref)) AS first_ref FROM kn GROUP BY 1),
ma AS (SELECT ident, first_ref, row_number() OVER (ORDER BY ident) + (SELECT max(security_id) FROM se) AS id FROM fi WHERE known_security IS NULL)"""
#: All pairs of an account's rows and lots in order, each taken if both are free.
LOTS_OF = f"""{LEDGER}, {SNAP}, sn AS (SELECT account_id, security_id, max(as_of_date) FILTER (as_of_date <= DATE '1998-05-31') AS d0, max(as_of_date) AS d1 FROM snap WHERE as_of_date <= DATE '1998-06-30' GROUP BY ALL),
rw AS (SELECT account_id, security_id % 5 AS s, security_id AS i, {TEXT(LOT_ROW['section'])} AS section, coalesce({TEXT(LOT_ROW['new_label'])}, '') AS label, {LOT_ROW['new_cost']} AS cost, {LOT_ROW['new_quantity']} AS q FROM snap JOIN sn USING (account_id, security_id) WHERE as_of_date = d1 AND security_id % 11 <> 0),
lt AS (SELECT account_id, security_id % 5 AS s, security_id AS l, {TEXT(LOT_ROW['old_label'])} AS label, {LOT_ROW['old_cost']} AS cost, {LOT_ROW['old_quantity']} AS q FROM snap JOIN sn USING (account_id, security_id) WHERE as_of_date = d0 AND security_id % 8 <> 3)"""
GAP = "CASE WHEN rw.{0} IS NULL AND lt.{0} IS NULL THEN 0 WHEN rw.{0} IS NULL OR lt.{0} IS NULL THEN 'inf'::DOUBLE ELSE abs(rw.{0} - lt.{0}) END".format
SOON = "split_part(label, '|', 2) = '', split_part(label, '|', 2)"
PAIRED = f"""WITH RECURSIVE {LOTS_OF},
pr AS (SELECT account_id, s, i, l, row_number() OVER (PARTITION BY account_id, s ORDER BY {GAP('cost')}, {GAP('q')}, i, l) AS k FROM rw JOIN lt USING (account_id, s) WHERE section = 'stock'),
gd AS (SELECT DISTINCT account_id, s, 0::BIGINT AS k, NULL::BIGINT AS i, NULL::BIGINT AS l, []::BIGINT[] AS ri, []::BIGINT[] AS li FROM pr
  UNION ALL SELECT g.account_id, g.s, p.k, CASE WHEN f THEN p.i END, CASE WHEN f THEN p.l END, CASE WHEN f THEN list_append(g.ri, p.i) ELSE g.ri END, CASE WHEN f THEN list_append(g.li, p.l) ELSE g.li END
  FROM (SELECT g.*, p.i AS pi, p.l AS pl, p.k AS pk, NOT list_contains(g.ri, p.i) AND NOT list_contains(g.li, p.l) AS f FROM gd g JOIN pr p ON p.account_id = g.account_id AND p.s = g.s AND p.k = g.k + 1) g, LATERAL (SELECT g.pi AS i, g.pl AS l, g.pk AS k) p),
r1 AS (SELECT *, row_number() OVER (PARTITION BY account_id, s, label ORDER BY i) AS k FROM rw WHERE section <> 'stock'), l1 AS (SELECT *, row_number() OVER (PARTITION BY account_id, s, label ORDER BY l) AS k FROM lt),
m1 AS (SELECT account_id, s, i, l FROM r1 JOIN l1 USING (account_id, s, label, k)),
r2 AS (SELECT account_id, s, i, split_part(label, '|', 1) AS t, row_number() OVER (PARTITION BY account_id, s, split_part(label, '|', 1) ORDER BY {SOON}, i) AS k FROM rw ANTI JOIN m1 USING (account_id, s, i) WHERE section <> 'stock'),
l2 AS (SELECT account_id, s, l, split_part(label, '|', 1) AS t, row_number() OVER (PARTITION BY account_id, s, split_part(label, '|', 1) ORDER BY {SOON}, l) AS k FROM lt ANTI JOIN m1 USING (account_id, s, l)),
mt AS (SELECT account_id, s, i, l FROM gd WHERE i IS NOT NULL UNION ALL SELECT * FROM m1 UNION ALL SELECT account_id, s, i, l FROM r2 JOIN l2 USING (account_id, s, t, k)),
tp AS (SELECT account_id, s, max(l) AS top FROM lt GROUP BY ALL)"""

SQL: dict[str, str] = {
    "name_links": f"""{LINKED} SELECT li."group", names, rows, undetermined, net_quantity, first_date, last_date, sid AS security_id, how, coalesce(live, 0) AS live, CASE WHEN sid IS NOT NULL THEN 'linked' WHEN live > 0 THEN 'choose' WHEN undetermined > 0 THEN 'unclear' WHEN net_quantity = 0 THEN 'sold' ELSE 'still held' END AS state
FROM li LEFT JOIN (SELECT "group", count(*) FILTER (against IS NULL) AS live FROM lv GROUP BY 1) USING ("group")""",
    "link_candidates": f"""{LINKED} SELECT "group", c AS security_id, checked, matched, shifted, verdict, against FROM lv""",
    "closed_securities": f"""{RICH}, s AS (SELECT {INDEX} AS i, quantity, {', '.join(f'{TEXT(v)} AS {k}' for k, v in SOLD.items())} FROM rich),
t AS (SELECT *, CASE WHEN regexp_matches(code, '^[0-9]{{4}}0$') THEN substr(code, 1, 4) END AS c, coalesce(nullif(money, ''), 'JPY') AS m, abs(CASE WHEN paid <> 0 THEN paid ELSE got END)::DOUBLE AS a FROM s),
h AS (SELECT name, arg_min(c, i) FILTER (c IS NOT NULL) AS code, count(*) FILTER (a <> 0 AND abs(quantity * price / 10000 - a) <= 1 + quantity * 0.5::DOUBLE / 10000) > count(*) FILTER (a <> 0 AND abs(quantity * price - a) <= 1 + quantity * 0.5::DOUBLE) AS many FROM t GROUP BY 1),
m AS (SELECT name, m, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, min(i)) AS k FROM t GROUP BY name, m)
SELECT name, code, CASE WHEN code IS NOT NULL THEN 'stock' WHEN many THEN 'fund' ELSE 'other' END AS asset_class, CASE WHEN code IS NULL AND many THEN 'unit' ELSE 'share' END AS unit, CASE WHEN many THEN 10000 ELSE 1 END AS divisor, m AS currency FROM h JOIN m USING (name) WHERE k = 1""",
    "current_spots": f"""{SPOTS} SELECT se.security_id, {r('CASE WHEN hand AND value IS NOT NULL AND sp.price IS NOT NULL THEN value ELSE sp.price END', 2)} AS price, price_currency, CASE WHEN hand AND value IS NOT NULL AND sp.price IS NOT NULL AND indexed THEN 'index' ELSE origin END AS origin,
  concat_ws(',', CASE WHEN sp.price IS NULL THEN 'no price' END, CASE WHEN origin = 'fallback' THEN 'last close' END, CASE WHEN price_currency <> currency THEN 'currency' END) AS warnings
FROM se LEFT JOIN sp USING (source, ref) LEFT JOIN ex USING (security_id)""",
    "fetch_plan": f"{FETCHING} SELECT source, ref, gap_start, gap_end FROM pl",
    "recorded_ranges": f"""{FETCHING}, al AS (SELECT DISTINCT source, ref, unnest(generate_series(s, e, INTERVAL 1 DAY))::DATE AS day FROM (SELECT * FROM cv UNION ALL SELECT * FROM re)), il AS (SELECT *, day - row_number() OVER (PARTITION BY source, ref ORDER BY day)::INTEGER AS island FROM al)
SELECT source, ref, min(day) AS start_date, max(day) AS end_date FROM il GROUP BY source, ref, island""",
    "recorded_attempts": f"""{FETCHING} SELECT * FROM tr ANTI JOIN pl USING (source, ref) UNION ALL SELECT source, ref, DATE '{FETCH_DAY}', (source, ref) IN (SELECT source, ref FROM re) FROM (SELECT DISTINCT source, ref FROM pl)""",
    "composable_gaps": f"""{BASE}, tx AS (SELECT * FROM ledger WHERE account_id % 4 = 1), dy AS (SELECT DISTINCT security_id, trade_date AS d FROM tx), mo AS (SELECT security_id, date_trunc('month', d)::DATE AS gap_start, last_day(d) AS gap_end, count(*) AS n FROM dy GROUP BY ALL),
ra AS (SELECT CASE security_id WHEN 1 THEN 'EUR' ELSE 'USD' END AS currency, date - 12 AS d FROM prices WHERE security_id IN (1, 2) AND month(date) % 3 = 0),
wa AS (SELECT *, CASE WHEN security_id % 2 = 0 THEN 'USD' ELSE 'EUR' END AS currency, min(gap_start) OVER (PARTITION BY security_id) - 7 AS lo FROM mo),
fi AS (SELECT w.security_id, min(ra.d) AS rate FROM (SELECT security_id, currency, lo, max(gap_end) AS hi FROM wa GROUP BY ALL) w JOIN ra ON ra.currency = w.currency AND ra.d BETWEEN lo AND hi GROUP BY 1),
ct AS (SELECT wa.security_id, gap_start, count(*) FILTER (d >= rate) AS composed FROM wa JOIN dy ON dy.security_id = wa.security_id AND d BETWEEN gap_start AND gap_end LEFT JOIN fi ON fi.security_id = wa.security_id GROUP BY ALL)
SELECT 'M' || wa.security_id AS ref, 'F' || wa.security_id AS future, currency, wa.gap_start, gap_end, (wa.security_id + month(wa.gap_start)) % 3 <> 0 AND gap_end <= CASE WHEN currency = 'USD' THEN DATE '1996-12-31' ELSE DATE '1999-12-31' END AND composed = n AS ready, composed FROM wa JOIN ct ON ct.security_id = wa.security_id AND ct.gap_start = wa.gap_start""",
    "section_totals": f"{SECTIONS} SELECT * FROM ss",
    "grand_totals": f"""{SECTIONS}, g AS (SELECT batch, CASE WHEN min(l_partkey) % 5 <> 1 THEN sum(gross) END::BIGINT AS expected, count(*) FILTER (l_partkey % 50 = 0) AS unread FROM d GROUP BY 1)
SELECT g.batch, c AS computed, expected, CASE WHEN expected IS NOT NULL THEN coalesce(c = expected, false) END AS ok, wrong AS wrong_sections, unread FROM g JOIN (SELECT batch, sum(computed)::BIGINT AS c, count(*) FILTER (NOT ok) AS wrong FROM ss GROUP BY 1) USING (batch)""",
    "statement_targets": TARGETS,
    "carried_back": f"""{BOTH}, {INS}, b AS (SELECT account_id, security_id, CASE WHEN cov = 'partial' THEN c0 END AS c0 FROM av), f1 AS (SELECT account_id, security_id, as_of_date AS fd, quantity AS q, avg_cost AS a, {ACQUIRED} AS acq FROM st QUALIFY row_number() OVER (PARTITION BY account_id, security_id ORDER BY as_of_date) = 1),
c1 AS (SELECT {G}, min(day) AS d FROM ch GROUP BY ALL),
o AS (SELECT account_id, security_id, CASE WHEN status IN ('traced', 'closed') THEN opening ELSE q END AS quantity, CASE WHEN status IN ('traced', 'closed') THEN coalesce(d, sx.first) ELSE fd END AS until, CASE WHEN status IN ('traced', 'closed') THEN nullif(c0, 0) ELSE a END AS unit_price, acq FROM sx LEFT JOIN c1 USING ({G}) LEFT JOIN f1 USING ({G}) LEFT JOIN b USING ({G}) JOIN ins USING (security_id)
  WHERE asset_class NOT IN ('cash', 'point', 'pension', 'real_estate') AND ((status IN ('traced', 'closed') AND opening > 1e-7) OR (status IN ('no_trades', 'no_earlier_trades') AND q > 0)))
SELECT {G}, {r('quantity')} AS quantity, until, {r('unit_price', 2)} AS unit_price, CASE WHEN acq < until THEN acq END AS acquired_on FROM o""",
    "lot_assignment": f"""{PAIRED} SELECT account_id, s AS security_id, l AS lot_seq, i AS row_id, CASE WHEN lt.q IS DISTINCT FROM rw.q THEN 'qty_changed' WHEN lt.cost IS DISTINCT FROM rw.cost THEN 'cost_changed' ELSE 'unchanged' END AS status, lt.q AS old_quantity, rw.q AS new_quantity, lt.cost AS old_cost, rw.cost AS new_cost FROM mt JOIN rw USING (account_id, s, i) JOIN lt USING (account_id, s, l)
UNION ALL SELECT account_id, s, coalesce(top, -1) + row_number() OVER (PARTITION BY account_id, s ORDER BY i), i, 'new', NULL, q, NULL, cost FROM rw ANTI JOIN mt USING (account_id, s, i) LEFT JOIN tp USING (account_id, s)
UNION ALL SELECT account_id, s, l, NULL, 'missing', q, NULL, cost, NULL FROM lt ANTI JOIN mt USING (account_id, s, l) WHERE q <> 0""",
    "committed_targets": f"""{ENSURED} SELECT batch, ref, kn.account, coalesce(na.account_id, ac.account_id) AS account_id, na.account_id IS NOT NULL AS new_account, known_security, id AS new_security FROM kn LEFT JOIN na ON na.account = kn.account LEFT JOIN ac ON ac.name = kn.account JOIN fi USING (ident) LEFT JOIN ma USING (ident)""",
    "committed_securities": f"""{ENSURED} SELECT id AS security_id, t0.code, t0.name, t0.name_key FROM ma JOIN t0 ON t0.ref = first_ref""",
    "name_overrides": f"""{LINKED}, ch AS (SELECT {TEXT(CHOICE['name'])} AS name, {CHOICE['to']} AS t FROM (SELECT s_suppkey AS security_id FROM supplier WHERE s_suppkey % 3 <> 2)),
mc AS (SELECT ms.name, "group", ch.name IS NOT NULL AS own, t FROM ms LEFT JOIN ch ON ch.name = ms.name), hi AS (SELECT "group", (list({{'t': t}} ORDER BY name <> "group", name) FILTER (own))[1].t AS t FROM mc GROUP BY 1 HAVING bool_or(own)),
ev AS (SELECT name, CASE WHEN own THEN mc.t ELSE hi.t END AS t FROM mc JOIN hi USING ("group") UNION ALL SELECT name, t FROM ch WHERE name NOT IN (SELECT name FROM ms)),
ek AS (SELECT replace(lower(name), ' ', '') AS k, (list({{'t': t}} ORDER BY name DESC))[1].t AS t FROM ev GROUP BY 1),
j AS (SELECT row_index, known, CASE WHEN known IS NOT NULL THEN CASE WHEN security_id % 2 = 0 THEN 'price' ELSE 'code' END END AS how, CASE WHEN ev.name IS NOT NULL THEN ev.t ELSE ek.t END AS t, (known IS NULL OR security_id % 2 = 0) AND (ev.name IS NOT NULL OR ek.k IS NOT NULL) AS chosen FROM lr LEFT JOIN ev ON ev.name = lr.name LEFT JOIN ek ON ek.k = replace(lower(lr.name), ' ', ''))
SELECT row_index, CASE WHEN chosen THEN t ELSE known END AS security_id, CASE WHEN NOT chosen THEN how WHEN t IS NOT NULL THEN 'manual' ELSE 'unmatched' END AS matched_by, CASE WHEN chosen THEN t IS NOT NULL AND row_index % 7 <> 0 AND row_index % 5 <> 0 ELSE known IS NOT NULL END AS included FROM j""",
    "coin_points": """WITH e AS (SELECT 'C' || user_id AS symbol, CASE event_type WHEN 'view' THEN 'value' WHEN 'click' THEN 'balance' WHEN 'purchase' THEN 'price' END AS m, ts::DATE AS t, max(floor(value * 100))::BIGINT AS v FROM events GROUP BY ALL)
SELECT symbol, 'value' AS kind, t, v::DOUBLE AS amount FROM e WHERE coalesce(m, 'value') = 'value' AND v % 10 <> 3 UNION ALL SELECT symbol, 'price', t, v + 2 FROM e WHERE m = 'price' AND v % 8 <> 5
UNION ALL SELECT symbol, 'quantity', t, v + 1 FROM e WHERE v % 9 <> 4 AND (m = 'balance' OR (coalesce(m, 'value') = 'value' AND symbol NOT IN (SELECT symbol FROM e WHERE m = 'balance')))""",
}
