"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from riskloom.llm.op1_ngram_join import op1_ngram_join
from riskloom.llm.op2_packing import op2_packing
from riskloom.llm.op3_lm_scoring import op3_lm_scoring
from riskloom.llm.op4_hilbert_shards import op4_hilbert_shards
from riskloom.llm.op5_quality import op5_quality
from riskloom.llm.op6_licenses import op6_licenses
from riskloom.llm.op7_decontaminate import op7_decontaminate
from riskloom.llm.op8_token_counts import op8_token_counts
from riskloom.llm.op9_simhash import op9_simhash
from riskloom.llm.op10_html_text import op10_html_text
from riskloom.llm.op11_language_id import op11_language_id
from riskloom.llm.op12_treap_search import op12_treap_search
from riskloom.llm.op13_spelling import op13_spelling

QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_packing, op3_lm_scoring, op4_hilbert_shards, op5_quality, op6_licenses,
                                   op7_decontaminate, op8_token_counts, op9_simhash, op10_html_text, op11_language_id,
                                   op12_treap_search, op13_spelling)}

_OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g
  FROM w),
n AS (SELECT doc_id, len(g) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
  WHERE 100 * c >= 80 * (a.n_shingles + b.n_shingles - c)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.x, r.root FROM r JOIN l ON l.y = r.doc_id)
SELECT n.doc_id, CAST(n_shingles AS BIGINT) AS n_shingles, min(root) AS component_id
FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n_shingles
"""

_OP12 = r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM documents),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark),
l AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM l),
f AS (SELECT t, doc_id, count(*) AS tf FROM d WHERE t IN (SELECT t FROM q) GROUP BY t, doc_id),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM (SELECT t, count(*) AS df FROM f GROUP BY t), c),
i AS (
  SELECT f.t, f.doc_id, w.w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms)))) AS impact
  FROM f JOIN w ON w.t = f.t JOIN l ON l.doc_id = f.doc_id, c),
s AS (SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN i ON i.t = q.t GROUP BY item_id, doc_id),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM s WHERE score > 0)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM r WHERE r <= 50
"""

_OP13 = r"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w
  FROM documents),
o AS (SELECT doc_id, w, count(*) AS k FROM runs WHERE length(w) >= 6 GROUP BY doc_id, w),
x AS (SELECT w, k, hex(encode(concat(doc_id, ':', w))) AS x FROM o WHERE doc_id IS NOT NULL),
h AS (
  SELECT w, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2),
         lambda i: CAST(concat('0x', substr(x, i, 2)) AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS h
  FROM x, tab),
res AS (
  SELECT CASE WHEN h % 199 = 0 THEN concat(substr(w, 1, h % length(w)), substr(w, h % length(w) + 2)) ELSE w END AS word, k FROM h
  UNION ALL SELECT w, k FROM o WHERE doc_id IS NULL),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM res WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
d AS (SELECT word, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (
  SELECT a.word AS word, b.word AS near FROM d a JOIN d b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, v.word FROM d JOIN v ON v.word = d.d
  UNION SELECT v.word, d.word FROM d JOIN v ON v.word = d.d),
g AS (
  SELECT p.word, p.near, v.n, count(*) OVER (PARTITION BY p.word) AS n_near,
         row_number() OVER (PARTITION BY p.word ORDER BY v.n DESC, p.near) AS r
  FROM p JOIN v ON v.word = p.near),
f AS (
  SELECT v.word, v.n, coalesce(g.n_near, 0) AS n_near, CASE WHEN g.n >= 5 * v.n THEN g.near END AS form,
         CASE WHEN g.n >= 5 * v.n THEN g.n END AS form_n
  FROM v LEFT JOIN g ON g.word = v.word AND g.r = 1),
c(word, root, step) AS (SELECT word, word, 0 FROM f UNION ALL SELECT c.word, f.form, step + 1 FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL),
e AS (SELECT word, arg_max(root, step) AS root FROM c GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN e ON e.word = f.word
"""

ORACLES = {"op1_ngram_join": _OP1, "op12_treap_search": _OP12, "op13_spelling": _OP13}
