"""SQL for DuckDB of the operators that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"


def _shingles(key: str, table: str) -> str:
    return f"""SELECT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w::VARCHAR || 'short']
                      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i:i+4]::VARCHAR)) END) AS s
               FROM (SELECT {key}, {_WORDS} AS w FROM {table})"""


OP1 = f"""
WITH d AS ({_shingles('doc_id', 'documents')}), b AS ({_shingles('item_id', 'benchmark')}),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS n_common FROM d JOIN b USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_common, n_item, n_common / n_item::DOUBLE AS containment FROM c JOIN n USING (item_id) WHERE 100 * n_common >= 75 * n_item
"""

OP7 = f"""
WITH RECURSIVE s AS ({_shingles('doc_id', 'documents')}),
n AS (SELECT doc_id, count(s.s) AS n FROM documents LEFT JOIN s USING (doc_id) GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * k >= 75 * (u.n + v.n - k)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""

OP9 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

OP10 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS t FROM (SELECT doc_id, h, unnest(range(0, (len(h) // 2 - 49)::BIGINT)) AS i FROM d)),
f AS (SELECT t, min(doc_id) AS m FROM w GROUP BY t HAVING count(*) > 1),
g AS (SELECT w.doc_id, w.i FROM w JOIN f USING (t) WHERE f.m < w.doc_id),
b AS (SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM g),
r AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM b),
x AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS z FROM r GROUP BY ALL),
k AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM x),
o AS (SELECT d.doc_id, any_value(h) AS h, coalesce(sum(z - a), 0) AS gone, count(a) AS spans, coalesce(string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a), '') AS head, coalesce(max(z), 0) AS rest
      FROM d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, gone::BIGINT AS n_removed, spans AS n_spans, sha256(unhex(head || substr(h, 2 * rest + 1))) AS kept_sha256 FROM o
"""
