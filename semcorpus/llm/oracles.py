"""SQL of the queries whose rows SQL can express, for DuckDB."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _more(value: str, cost: str, edit: str) -> str:
    """A value is its cost in eight digits and the edits; this adds one."""
    return f"(printf('%08d', CAST(left({value}, 8) AS INTEGER) + {cost}) || substr({value}, 9) || {edit})"


_INSERTED = f"""s0, s1, c2, least(s3, {_more("c2", "3", "'I'")}) AS c3"""
_USERS = f"""least(s2, {_more("s0", "3", "'I'")}, {_more("s1", "3", "'I'")}, {_more("s3", "3", "'I'")}) AS c2"""


def _taken(state: str, letter: str) -> str:
    cost = f"(3 * truncated + CASE WHEN initial = '{letter}' THEN 0 ELSE 3 END)"
    edit = f"CASE WHEN initial = '{letter}' THEN 'K' ELSE 'R' END"
    return f"CASE WHEN gone = 0 THEN {_more(state, cost, edit)} END"


OP11 = f"""
WITH RECURSIVE bits AS (
  SELECT n, CAST(n AS BIGINT) AS c, 0 AS step FROM range(256) t(n)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8),
tab AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE step = 8),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations),
keys AS (SELECT DISTINCT k FROM keyed),
crc AS (
  SELECT k, 0 AS i, CAST(4294967295 AS BIGINT) AS c FROM keys
  UNION ALL SELECT k, i + 1, xor(c >> 8, t[CAST(xor(c, ord(substr(k, i + 1, 1))) & 255 AS INTEGER) + 1])
  FROM crc, tab WHERE i < length(k)),
codes AS (SELECT k, xor(c, 4294967295) % 20 AS code FROM crc WHERE i = length(k)),
damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN code = 1 THEN '' WHEN code = 2 THEN translate(text, '.!?', '') ELSE text END AS text, n
  FROM keyed JOIN codes USING (k) JOIN (VALUES (1), (2)) v(n) ON n = 1 OR code = 3 WHERE code <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, n) AS i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid
  FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS copy FROM numbered),
faults AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS initial, CASE WHEN solid = '' THEN 1 ELSE 0 END AS blank,
    CASE WHEN solid <> '' AND copy > 1 THEN 1 ELSE 0 END AS duplicate,
    CASE WHEN solid <> '' AND copy = 1 AND right(solid, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS truncated
  FROM seen),
turns AS (
  SELECT *, blank + duplicate AS gone,
    CASE WHEN i > 1 AND lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END AS bad
  FROM faults),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank) AS blank, sum(duplicate) AS duplicate,
    sum(truncated) AS truncated, sum(bad) AS illegal, count(*) AS size FROM turns GROUP BY conv_id),
walk AS (
  SELECT conv_id, size, 0 AS i, '00000000' AS s0, CAST(NULL AS VARCHAR) AS s1, CAST(NULL AS VARCHAR) AS s2, CAST(NULL AS VARCHAR) AS s3 FROM counted
  UNION ALL
  SELECT w.conv_id, size, t.i, {_more("s0", "4", "'D'")},
    least({_more("s1", "4", "'D'")}, CASE WHEN gone = 0 AND initial = 's' THEN {_more("s0", "3 * truncated", "'K'")} END),
    least({_more("c2", "4", "'D'")}, {_taken("s0", "u")}, {_taken("s1", "u")}, {_taken("c3", "u")}),
    least({_more("c3", "4", "'D'")}, {_taken("c2", "a")})
  FROM (SELECT conv_id, size, i, {_INSERTED} FROM (SELECT conv_id, size, i, s0, s1, s3, {_USERS} FROM walk WHERE i < size) x) w
  JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1),
ended AS (
  SELECT conv_id, least(s0, c3) AS best FROM (
    SELECT conv_id, {_INSERTED} FROM (SELECT conv_id, s0, s1, s3, {_USERS} FROM walk WHERE i = size) x) y),
edits AS (
  SELECT conv_id, j, e, sum(CASE WHEN e <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY j) AS i,
    sum(CASE WHEN e <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY j) AS o
  FROM (SELECT conv_id, j, substr(best, 8 + j, 1) AS e FROM (SELECT conv_id, best, unnest(range(1, length(best) - 7)) AS j FROM ended) z) y),
placed AS (
  SELECT d.conv_id, j, e, o, t.role, t.text, CASE WHEN o = 1 AND e = 'K' AND initial = 's' THEN 1 ELSE 0 END AS head
  FROM edits d LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM d.conv_id AND t.i = d.i AND e <> 'I' WHERE e <> 'D'),
headed AS (SELECT *, max(head) OVER (PARTITION BY conv_id) AS has FROM placed),
said AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (o - has) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
    || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS h FROM headed GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(left(best, 8), '0') AS BIGINT) AS cost,
  coalesce(substr(best, 9), '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN said s ON s.conv_id IS NOT DISTINCT FROM o.conv_id"""


OP12 = f"""
WITH RECURSIVE docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS x FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(x, '[.,;:!?\\n\\v\\f\\r]')) AS piece FROM docs),
lists AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM pieces),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM spots, (VALUES (1), (2), (3), (4)) v(k)
  WHERE i + k - 1 <= len(w)),
counts AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY lang, k, phrase),
totals AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang),
cands AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, n AS a FROM counts WHERE k > 1 AND n >= 30),
held AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS most
  FROM cands, (VALUES (1), (2), (3)) p(i), (VALUES (2), (3)) q(m) WHERE m < k AND i + m - 1 <= k GROUP BY 1, 2),
kept AS (SELECT c.* FROM cands c LEFT JOIN held h USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * a),
cuts AS (
  SELECT c.lang, c.phrase, a, j, l.n AS l, r.n AS r, (CAST(2000000 AS HUGEINT) * a) // (l.n + r.n) AS score
  FROM kept c JOIN (VALUES (1), (2), (3)) p(j) ON j < c.k
  JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:j], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1 : c.k], ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM cuts),
edges AS (SELECT lang, phrase, a, array_to_string(w[1:3], ' ') AS b, array_to_string(w[2:4], ' ') AS e FROM cands WHERE k = 4),
enters AS (SELECT lang, e AS node, count(*) AS ways, max(a) AS m FROM edges GROUP BY lang, e),
leaves AS (SELECT lang, b AS node, count(*) AS ways, max(a) AS m FROM edges GROUP BY lang, b),
unary AS (
  SELECT lang, node FROM enters x JOIN leaves y USING (lang, node) JOIN cands f ON f.lang = x.lang AND f.phrase = node
  WHERE x.ways = 1 AND y.ways = 1 AND x.m = f.a AND y.m = f.a),
chains AS (
  SELECT lang, phrase AS head, phrase, e, 0 AS place FROM edges WHERE (lang, b) NOT IN (SELECT (lang, node) FROM unary)
  UNION ALL SELECT c.lang, head, d.phrase, d.e, place + 1 FROM chains c JOIN unary u ON u.lang = c.lang AND u.node = c.e
    JOIN edges d ON d.lang = u.lang AND d.b = u.node),
sizes AS (SELECT lang, head, max(place) + 4 AS size FROM chains GROUP BY lang, head),
ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, t.n,
    CAST(score AS BIGINT) AS score, CAST(coalesce(size, len(string_split(b.phrase, ' '))) AS BIGINT) AS passage
  FROM best b JOIN totals t ON t.lang = b.lang LEFT JOIN chains c ON c.lang = b.lang AND c.phrase = b.phrase
  LEFT JOIN sizes s ON s.lang = c.lang AND s.head = c.head WHERE o = 1)
SELECT * FROM ranked WHERE rank <= 2000"""


_REACH = """, reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS id, min(b) AS c FROM reach GROUP BY a)"""

OP5 = f"""
WITH RECURSIVE vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS (SELECT * FROM vecs WHERE list_aggregate(list_transform(e, lambda x: CASE WHEN isfinite(x) THEN x * x END), 'sum') > 0
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95){_REACH},
degree AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least(c, vec_id), vec_id) AS component_id,
  vec_id = coalesce(least(c, vec_id), vec_id) AS kept
FROM vecs LEFT JOIN degree d ON d.id = vec_id LEFT JOIN least l ON l.id = vec_id"""

OP6 = f"""
WITH RECURSIVE lists AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
spots AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM lists WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM spots),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON y.s = x.s AND y.doc_id <> x.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)){_REACH}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(c, d.doc_id), d.doc_id) AS component_id,
  d.doc_id = coalesce(least(c, d.doc_id), d.doc_id) AS kept
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN least l ON l.id = d.doc_id"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), '{u}', '{l}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format(u=UPPER, l=LOWER)
OP10 = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, row_number() OVER () AS k, {_WORDS} AS w FROM benchmark),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM docs),
asked AS (SELECT k, len(w) AS n, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x FROM items),
meets AS (SELECT doc_id, k, n, i, i - j AS diagonal FROM words JOIN asked USING (x)),
numbered AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, k, diagonal ORDER BY i) AS run FROM meets),
runs AS (SELECT doc_id, k, min(i) AS a, max(i) AS b FROM numbered GROUP BY doc_id, k, diagonal, run, n HAVING count(*) >= least(10, n)),
hit AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM runs) h GROUP BY doc_id),
held AS (SELECT doc_id, max(b - a + 1) AS longest FROM runs GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS said FROM (
  SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM runs JOIN items USING (k) WHERE item_id IS NOT NULL) m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items,
  sha256(coalesce(said, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest
FROM docs d LEFT JOIN hit h ON h.doc_id = d.doc_id LEFT JOIN held l ON l.doc_id = d.doc_id LEFT JOIN names m ON m.doc_id = d.doc_id"""
