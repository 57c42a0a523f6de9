"""DuckDB SQL of the operator queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
_BLANK = rf"coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), [])"

OP2 = rf"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
  items AS (SELECT item_id, w, least(13, len(w)) AS m FROM (SELECT item_id, {_ALNUM} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
  win AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM items)),
  dw AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM items))),
  hits AS (SELECT DISTINCT doc_id, i, dw.m, item_id FROM dw JOIN win ON dw.m = win.m AND dw.k = win.k),
  pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
  its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP3 = rf"""
WITH d AS (SELECT doc_id, {_BLANK} AS w FROM documents),
  t AS (SELECT doc_id, w[i] AS x, CASE WHEN i > 1 THEN w[i - 1] END AS h FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d)),
  u AS (SELECT x, count(*) AS c FROM t GROUP BY x), n AS (SELECT sum(c) AS n FROM u),
  b AS (SELECT h, x, count(*) AS c FROM t WHERE h IS NOT NULL GROUP BY h, x HAVING count(*) >= 2),
  s AS (SELECT doc_id, count(*) AS n_tokens, count(b.c) AS n_seen, sum(CASE WHEN b.c IS NOT NULL THEN ln(b.c) - ln(uh.c) ELSE ln(u.c) - ln(n.n) + CASE WHEN t.h IS NULL THEN 0 ELSE ln(0.4) END END) AS score
    FROM t JOIN u ON t.x = u.x LEFT JOIN u uh ON t.h = uh.x LEFT JOIN b ON t.h = b.h AND t.x = b.x, n GROUP BY doc_id)
SELECT doc_id, coalesce(n_tokens, 0) AS n_tokens, coalesce(n_seen, 0) AS n_seen, round(coalesce(score, 0.0), 3) AS score FROM d LEFT JOIN s USING (doc_id)
"""

OP9 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_BLANK} AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0))),
  z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
  l AS (SELECT a, b FROM o JOIN z za ON a = za.doc_id JOIN z zb ON b = zb.doc_id WHERE 100 * c >= 75 * (za.n + zb.n - c)),
  e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m.component_id FROM d LEFT JOIN z USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON d.doc_id = m.a
"""
