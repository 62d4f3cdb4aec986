"""DuckDB SQL for the corpus queries that SQL can express.

The others rest on trained models or hash-ranked samples; tests hold them against plain versions, exact
round trips or held-out accuracy.
"""

#: CRC-32's table, by its polynomial.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i))"


def _codes(parts: int, rounds: int, scale: int, entries: int) -> str:
    """Rounds of assignment and means, one table expression after the other."""
    steps, found = [], ""
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT x.r, x.p, min({{'d': d, 'e': e}}) AS best FROM (SELECT q.r, q.p, b.e, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - b.v[i]) * (q.v[i] - b.v[i])))::BIGINT AS d FROM q JOIN b{r} b USING (p)) x GROUP BY x.r, x.p)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT p, e, list(m ORDER BY i) AS v FROM (SELECT q.p, a.best.e AS e, u.i, floor(sum(q.v[u.i]) / count(*))::BIGINT AS m FROM q JOIN a{r} a USING (r, p), LATERAL (SELECT unnest(range(1, len(q.v) + 1)) AS i) u GROUP BY ALL) GROUP BY p, e),
b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m USING (p, e))""")
    found = ",\n".join(steps)
    return f"""
WITH k AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS MATERIALIZED (SELECT r, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS v FROM k, range({parts}) t(p)),
f AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k),
b0 AS MATERIALIZED (SELECT q.p, f.e, q.v FROM q JOIN f USING (r) WHERE f.e < {entries}),
{found},
h AS (SELECT sha256(string_agg(list_aggregate(v, 'string_agg', ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}),
c AS (SELECT k.r, k.vec_id, k.label, string_agg(lower(printf('%02x', a.best.e)), '' ORDER BY a.p) AS code, sum(a.best.d)::BIGINT AS error FROM k JOIN a{rounds} a USING (r) GROUP BY ALL)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256, label FROM c, h"""


SQL: dict[str, str] = {
    "op1_warc_capture_index": """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, url, octet_length(encode(body))::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, url, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)""",
    # regular expressions, MD5 and window sums, as in the operator: the rounds of order sampling one after the other
    "op2_source_mix": r"""
WITH b AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  (('0x' || substr(md5(concat_ws(':', '17', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
d AS (SELECT *, floor(log2(greatest(size, 1)::DOUBLE))::INTEGER AS k FROM b),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT source, source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS w, source_size * 3.0::DOUBLE AS lim FROM s0),
s2 AS (SELECT *, row_number() OVER o AS n_th, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(lim) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s1 WINDOW o AS (ORDER BY lim / w, source NULLS LAST)),
s3 AS (SELECT *, min(CASE WHEN lim >= level * w THEN n_th END) OVER () AS first FROM s2),
t AS (SELECT source, source_size, CASE WHEN n_th >= first THEN least(w * (SELECT level FROM s3 x WHERE x.n_th = x.first), lim) ELSE lim END AS target FROM s3),
c0 AS (SELECT source, k, sum(size)::BIGINT AS words, pow(2.0::DOUBLE, -k * 0.125::DOUBLE) AS x FROM d GROUP BY ALL),
c1 AS (SELECT c0.*, target, source_size, coalesce(sum(words) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 3.0::DOUBLE AS whole_words,
  sum(words * x) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM c0 JOIN t ON c0.source IS NOT DISTINCT FROM t.source WINDOW w AS (PARTITION BY c0.source ORDER BY k)),
c2 AS (SELECT *, CASE WHEN rest = 0 THEN NULL ELSE (target - whole_words) / rest END AS c FROM c1),
c3 AS (SELECT *, min(CASE WHEN c * x <= 3.0 * (1 + 1e-12) THEN k END) OVER (PARTITION BY source) AS k0 FROM c2),
c4 AS (SELECT *, max(CASE WHEN k = k0 THEN c END) OVER (PARTITION BY source) AS c_all FROM c3),
mu AS (SELECT source, k, source_size, target, words, greatest(coalesce(CASE WHEN k < k0 THEN 3.0 ELSE least(c_all * x, 3.0) END, 0), 0)::DOUBLE AS mu FROM c4),
m AS (SELECT *, floor(mu + 1e-9) AS whole, greatest(mu - floor(mu + 1e-9), 0) AS pi, target - sum(floor(mu + 1e-9) * words) OVER (PARTITION BY source) AS room FROM mu),
q AS (SELECT doc_id, d.source, size, source_size, target, whole, pi, room, false AS more,
  (u / (1 - u)) / (greatest(least(pi, 1 - 1e-12), 1e-12) / (1 - greatest(least(pi, 1 - 1e-12), 1e-12))) AS q FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source AND d.k = m.k),
o1 AS (SELECT *, sum(CASE WHEN pi > 0 AND size > 0 AND size <= room AND NOT more THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q) AS upto FROM q),
f1 AS (SELECT * REPLACE (more OR (pi > 0 AND size > 0 AND size <= room AND upto <= room) AS more), more AS old FROM o1),
r1 AS (SELECT * EXCLUDE (old, upto) REPLACE (room - sum(CASE WHEN more AND NOT old THEN size ELSE 0 END) OVER (PARTITION BY source) AS room) FROM f1),
o2 AS (SELECT *, sum(CASE WHEN pi > 0 AND size > 0 AND size <= room AND NOT more THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q) AS upto FROM r1),
f2 AS (SELECT * REPLACE (more OR (pi > 0 AND size > 0 AND size <= room AND upto <= room) AS more), more AS old FROM o2),
r2 AS (SELECT * EXCLUDE (old, upto) REPLACE (room - sum(CASE WHEN more AND NOT old THEN size ELSE 0 END) OVER (PARTITION BY source) AS room) FROM f2),
o3 AS (SELECT *, sum(CASE WHEN pi > 0 AND size > 0 AND size <= room AND NOT more THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q) AS upto FROM r2),
f3 AS (SELECT * REPLACE (more OR (pi > 0 AND size > 0 AND size <= room AND upto - size / 2 <= room) AS more), more AS old FROM o3),
r3 AS (SELECT * EXCLUDE (old, upto) REPLACE (room - sum(CASE WHEN more AND NOT old THEN size ELSE 0 END) OVER (PARTITION BY source) AS room) FROM f3),
z AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE least(whole + more::INTEGER, 3) END::INTEGER AS copies FROM r3)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies, source FROM z""",
    "op4_snapshot_collapse": """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER w AS position, count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM conversations WHERE conv_id IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY coalesce(turn, -1), role, text)),
h AS (SELECT conv_id, position, n_turns, sha256(string_agg(sha256(role || chr(1) || text), '') OVER (PARTITION BY conv_id ORDER BY position)) AS prefix FROM t),
ends AS (SELECT prefix, min(conv_id) AS conv_id FROM h WHERE position = n_turns GROUP BY prefix),
kept AS (SELECT conv_id FROM ends WHERE prefix NOT IN (SELECT prefix FROM h WHERE position < n_turns))
SELECT conv_id, position, n_turns, role, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS rendered FROM t WHERE conv_id IN (SELECT conv_id FROM kept)""",
    "op6_vertical_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
r AS (SELECT doc_id, doc_id AS other FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
k AS (SELECT a AS doc_id, count(*) AS links FROM e GROUP BY 1)
SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(other) AS component_id, coalesce(any_value(k.links), 0)::BIGINT AS n_links FROM r LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id) GROUP BY doc_id""",
    "op8_exact_top_k": """
WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
t AS (SELECT vec_id, r, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM v),
s AS (SELECT a.vec_id AS query_id, a.r AS query_row, b.vec_id, b.r, sum(a.x * b.x)::BIGINT AS score FROM t a JOIN t b USING (i) WHERE a.vec_id % 50 = 0 AND a.r <> b.r GROUP BY ALL),
k AS (SELECT query_id, (row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5""",
    "op11_bottom_k_fingerprints": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(text) OVER w, first_value(text) OVER w, '') AS after FROM documents WINDOW w AS (ORDER BY doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT doc_id, t, after, left(t, length(t) - length(t) // 4) || left(after, length(t) // 4) AS edited FROM d),
w AS (SELECT *, list_transform([t, edited, after], lambda x: regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS ws FROM e),
s AS (SELECT *, list_transform(ws, lambda w: CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [left(md5(array_to_string(w, ' ')), 16)] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: left(md5(array_to_string(w[i:i + 4], ' ')), 16))))[1:128] END) AS s FROM w),
u AS (SELECT *, list_sort(list_distinct(s[1] || s[2]))[1:128] AS ue, list_sort(list_distinct(s[1] || s[3]))[1:128] AS un FROM s),
j AS (SELECT *, CASE WHEN len(ue) = 0 THEN 1 ELSE len(list_intersect(list_intersect(ue, s[1]), s[2]))::DOUBLE / len(ue)::DOUBLE END AS near_edited, CASE WHEN len(un) = 0 THEN 1 ELSE len(list_intersect(list_intersect(un, s[1]), s[3]))::DOUBLE / len(un)::DOUBLE END AS near_next,
  CASE WHEN len(s[1]) < 128 THEN len(s[1])::DOUBLE ELSE 127::DOUBLE / ((('0x' || s[1][-1])::UBIGINT::DOUBLE + 1) / 18446744073709551616::DOUBLE) END AS n_distinct, CASE WHEN len(un) < 128 THEN len(un)::DOUBLE ELSE 127::DOUBLE / ((('0x' || un[-1])::UBIGINT::DOUBLE + 1) / 18446744073709551616::DOUBLE) END AS n_both FROM u)
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, array_to_string(s[1], '') AS fingerprint, array_to_string(s[2], '') AS edited_fingerprint, near_edited::DOUBLE AS near_edited, near_next::DOUBLE AS near_next, n_distinct,
  CASE WHEN len(s[1]) = 0 THEN 1::DOUBLE ELSE least(1::DOUBLE, near_next * n_both / n_distinct) END AS in_next FROM j""",
    "op12_spelling_variants": rf"""
WITH RECURSIVE t AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{{7,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
c AS (SELECT doc_id, r, count(*) AS n FROM r GROUP BY ALL),
x AS (SELECT r, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)) AS x FROM c),
h AS (SELECT r, n, xor(list_reduce(list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT), lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM x, t),
z AS (SELECT CASE WHEN h % 31 = 0 THEN left(r, (h % length(r))::BIGINT) || substr(r, (h % length(r))::BIGINT + 2) ELSE r END AS word, n FROM h),
d AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM z WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
g AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS less FROM d, LATERAL (SELECT unnest(range(length(word))) AS i) u),
e AS (SELECT a.word, b.word AS near, b.n FROM g a JOIN g b ON a.less = b.less AND a.i = b.i AND a.word <> b.word UNION SELECT g.word, d.word, d.n FROM g JOIN d ON g.less = d.word UNION SELECT d.word, g.word, g.n FROM g JOIN d ON g.less = d.word),
b AS (SELECT word, count(*) AS n_near, min({{'n': -n, 'w': near}}) AS best FROM e GROUP BY word),
f AS MATERIALIZED (SELECT d.word, d.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN -b.best.n >= 10 * d.n THEN b.best.w END AS form, CASE WHEN -b.best.n >= 10 * d.n THEN (-b.best.n)::BIGINT END AS form_n FROM d LEFT JOIN b USING (word)),
w AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT w.word, f.form, step + 1 FROM w JOIN f ON f.word = w.root WHERE f.form IS NOT NULL),
l AS (SELECT word, arg_max(root, step) AS root FROM w GROUP BY word)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n FROM f JOIN l USING (word)""",
    "op13_vector_codes": _codes(4, 4, 1024, 256),
}
