"""SQL for an independent engine: results of the operators that SQL can express.

Written from the definitions. Pairs and windows over whole tables are fine here.
"""

from __future__ import annotations

from plumbline.llm.licenses import PHRASES, TEMPLATES, THRESHOLD
from plumbline.llm.mixing import SEED

ORACLE: dict[str, str] = {}

ORACLE["op4_mixing"] = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
lab AS (SELECT doc_id, max(quality * 1.5::DOUBLE + 0.5::DOUBLE) AS w FROM labels GROUP BY doc_id),
k AS (SELECT d.*, -ln((('0x' || substr(md5('{SEED}|' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
             / CASE WHEN w > 0 THEN w ELSE 1.0::DOUBLE END AS ord
      FROM d LEFT JOIN lab ON lab.doc_id = d.doc_id),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM d GROUP BY source),
s AS (SELECT *, 3.0::DOUBLE * source_size AS cap, CASE nth % 3 WHEN 1 THEN 5.0::DOUBLE WHEN 2 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
             (SELECT sum(source_size)::DOUBLE FROM s0) AS total FROM s0),
full_ AS (SELECT s.nth FROM s, s AS o GROUP BY s.nth, s.cap, s.w, s.total HAVING sum(least(o.cap, o.w * (s.cap / s.w))) <= s.total),
lev AS (SELECT (any_value(total) - coalesce(sum(cap) FILTER (WHERE nth IN (FROM full_)), 0)) / nullif(sum(w) FILTER (WHERE nth NOT IN (FROM full_)), 0) AS level FROM s),
t AS (SELECT source, source_size, CASE WHEN nth IN (FROM full_) THEN cap ELSE w * level END AS target FROM s, lev),
r AS (SELECT k.*, source_size, target, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS epochs,
             sum(size) OVER (PARTITION BY k.source ORDER BY ord, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
m AS (SELECT *, target - epochs * source_size AS rest FROM r),
c AS (SELECT *, epochs + CASE WHEN size = 0 THEN 0 WHEN upto <= rest OR (upto - size < rest AND upto - rest < rest - upto + size) THEN 1 ELSE 0 END AS copies FROM m)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken FROM c"""

_ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)


def _found(kind: str, nth: int, pattern: str, group: int, keep: str) -> str:
    return f"""
    SELECT doc_id, owner, repo, '{kind}' AS kind, {nth} AS nth, vs[i] AS value,
           (list_sum(list_transform(gaps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: len(x))), 0))::BIGINT AS a,
           len(ms[i]) AS n
    FROM (SELECT doc_id, owner, repo, ms, vs, gaps, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT doc_id, coalesce(source, chr(0)) AS owner, {{'s': source, 'l': lang}} AS repo, regexp_extract_all(t, '{pattern}', 0) AS ms,
             regexp_extract_all(t, '{pattern}', {group}) AS vs, string_split_regex(t, '{pattern}') AS gaps
      FROM (SELECT *, coalesce(text, '') AS t FROM documents)))
    WHERE {keep}"""


_SPAN = "string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, nth)"
ORACLE["op2_secrets"] = f"""
WITH f AS ({_found('assign', 1, _ASSIGN, 2, 'len(vs[i]) >= 12')} UNION ALL {_found('access', 2, 'AKIA[A-Z0-9]+', 0, 'len(ms[i]) >= 18')}
  UNION ALL {_found('hex', 3, '[0-9a-f]+', 0, 'len(ms[i]) >= 16')}),
g0 AS ({_found('generic', 4, '[A-Za-z0-9_-]+', 0, "len(ms[i]) >= 20 AND regexp_matches(ms[i], '[0-9]') AND regexp_matches(ms[i], '[A-Za-z]')")}),
g AS (SELECT * FROM g0 WHERE NOT EXISTS (FROM f WHERE f.doc_id = g0.doc_id AND f.a < g0.a + g0.n AND g0.a < f.a + f.n)),
al AS (SELECT * FROM f UNION ALL SELECT * FROM g),
ow AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT repo) AS repos, owners <= 2 AND repos <= 6 AS live FROM al GROUP BY value),
j AS (SELECT al.*, owners, repos, live FROM al JOIN ow ON al.value = ow.value),
p AS (SELECT doc_id, {_SPAN} FILTER (WHERE kind <> 'generic') AS base, {_SPAN} FILTER (WHERE kind <> 'generic' OR live) AS spans,
             count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
             count(*) FILTER (WHERE kind = 'hex') AS n_hex, count(DISTINCT value) FILTER (WHERE live) AS n_live,
             count(DISTINCT value) FILTER (WHERE NOT live) AS n_copied,
             max(owners) FILTER (WHERE kind <> 'generic' OR live) AS most_owners, max(repos) FILTER (WHERE kind <> 'generic' OR live) AS most_repos FROM j GROUP BY doc_id)
SELECT d.doc_id AS doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied,
       coalesce(most_owners, 0) AS most_owners, coalesce(most_repos, 0) AS most_repos
FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE["op6_ngram_join"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS h FROM w),
s AS (SELECT doc_id, len(h) AS n, unnest(h) AS x FROM h),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS o FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o WHERE 100 * o >= 75 * (na + nb - o)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a)
SELECT r.doc_id AS doc_id, any_value(len(h))::BIGINT AS n_shingles, min(c) AS component_id FROM r JOIN h ON h.doc_id = r.doc_id GROUP BY r.doc_id"""

# CRC-32 of the decimal name, a bit at a time: xor with the byte, then eight shifts.
_CRC = (
    "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ord(s)::BIGINT), "
    "lambda a, b: list_reduce([xor(a, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], "
    "lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)), 4294967295)"
)
ORACLE["op11_prefix_trie"] = rf"""
WITH t AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, ({_CRC} % 4)::INT AS h FROM t),
r AS (SELECT h.conv_id AS c, list_concat(coalesce(b.l, [])[1:h.h], h.l[h.h + 1:]) AS l FROM h LEFT JOIN t AS b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT c, d, len(l) AS n, l[1:d] AS p, l[1:d - 1] AS q FROM (SELECT *, unnest(range(0, len(l) + 1)) AS d FROM r)),
nd AS (SELECT d, p, min(CASE WHEN d = 0 THEN NULL ELSE q END) AS q, min(c) AS conv, count(*) AS n_convs,
              (count(*) - 1) * coalesce(len(regexp_extract_all(p[d].t, '[^\x20\x09-\x0D]+')), 0) AS saved,
              sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends FROM p GROUP BY d, p),
ch AS (SELECT d - 1 AS d, q AS p, count(*) AS n_children FROM nd WHERE d > 0 GROUP BY ALL),
x AS (SELECT nd.*, coalesce(n_children, 0) AS n_children FROM nd LEFT JOIN ch ON ch.d = nd.d AND ch.p = nd.p),
up AS (SELECT e, p[1:e] AS p, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved
       FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM x) GROUP BY ALL)
SELECT x.conv AS conv_id, x.d AS depth, o.conv AS parent_conv_id, x.n_convs, x.n_children, n_leaves, up.saved AS saved_tokens, x.ends AS ends_sha256
FROM x JOIN up ON up.e = x.d AND up.p = x.p LEFT JOIN nd AS o ON o.d = x.d - 1 AND o.p = x.q"""

_cuts = " UNION ALL ".join(
    f"SELECT lang, g, a, {k} AS k, g[1:{k}] AS x, g[{k + 1}:] AS y FROM kept WHERE len(g) > {k}" for k in range(1, 5)
)
ORACLE["op12_collocations"] = rf"""
WITH p AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w
           FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS t FROM documents)),
g AS (SELECT lang, w[i:i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 6) AS r(k))),
f AS (SELECT lang, g, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE len(g) = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE a >= 100 AND len(g) >= 2),
inner_ AS (SELECT DISTINCT lang, a, g[i:j] AS g FROM (SELECT *, unnest(range(i + 1, len(g) + 1)) AS j FROM (SELECT *, unnest(range(1, len(g))) AS i FROM c)) WHERE j - i + 1 < len(g)),
kept AS (SELECT c.* FROM c ANTI JOIN inner_ USING (lang, g, a)),
cut AS ({_cuts}),
s AS (SELECT cut.*, l.a AS l, r.a AS r, n, (1000::HUGEINT * cut.a * n) // (l.a::HUGEINT * r.a) AS score
      FROM cut JOIN f AS l ON l.lang = cut.lang AND l.g = x JOIN f AS r ON r.lang = cut.lang AND r.g = y JOIN n ON n.lang = cut.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank,
             array_to_string(g, ' ') AS phrase, a, l, r, n, score::BIGINT AS score FROM b)
SELECT * FROM o WHERE rank <= 2000"""

ORACLE["op13_minhash_dedup"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS h FROM w),
s AS (SELECT doc_id, len(h) AS n, unnest(h) AS x FROM h),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS o FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o WHERE 100 * o >= 80 * (na + nb - o)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a)
SELECT r.doc_id AS doc_id, any_value(len(h))::BIGINT AS n_shingles, min(c) AS component_id, min(c) = r.doc_id AS kept
FROM r JOIN h ON h.doc_id = r.doc_id GROUP BY r.doc_id"""

ORACLE["op8_neighbours"] = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
             AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.x, c.x) AS score FROM v q, v c
      WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.x) = len(c.x)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 20"""

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_at = " UNION ALL ".join(
    f"SELECT doc_id, '{label}' AS label, unnest(list_filter(range(1, len(w) - {len(p.split()) - 2}), "
    f"lambda i: w[i:i + {len(p.split()) - 1}] = {p.split()})) - 1 AS place FROM w"
    for p, label in PHRASES.items()
)
_templates = " UNION ALL ".join(
    f"SELECT '{name}' AS label, {sorted(set(t.split()))} AS t, {-(-5 * len(t.split()) // 4)} AS width" for name, t in TEMPLATES.items()
)
ORACLE["op9_licenses"] = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents),
at0 AS ({_at}),
b AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS own FROM at0 GROUP BY doc_id),
te AS ({_templates}),
tw AS (SELECT label, width, len(t) AS size, ceil({THRESHOLD}::DOUBLE * len(t) - 1e-9) AS need, unnest(t) AS word FROM te),
oc0 AS (SELECT doc_id, label, width, size, need, place, word FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS place FROM w) JOIN tw USING (word)),
oc AS (SELECT * FROM oc0 SEMI JOIN (SELECT doc_id, label FROM oc0 GROUP BY doc_id, label, need HAVING count(DISTINCT word) >= need) USING (doc_id, label)),
mt AS (SELECT a.doc_id, a.label, count(DISTINCT b.word) / any_value(a.size)::DOUBLE AS share
       FROM oc a JOIN oc b ON a.doc_id = b.doc_id AND a.label = b.label AND b.place BETWEEN a.place - a.width + 1 AND a.place
       GROUP BY a.doc_id, a.label, a.place, a.need HAVING count(DISTINCT b.word) >= a.need),
m AS (SELECT doc_id, list(DISTINCT label) AS more, max(share) AS share FROM mt GROUP BY doc_id)
SELECT w.doc_id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       array_to_string(list_sort(coalesce(own, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM w LEFT JOIN b ON b.doc_id = w.doc_id LEFT JOIN m ON m.doc_id = w.doc_id"""
