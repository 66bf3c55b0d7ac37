"""Query 6."""

from . import near_dups
from .common import table
from .registry import query


@query("op6_superminhash", """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)] END)) AS shingle FROM w
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
k AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT x, y FROM k JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
reached AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT d, y FROM reached JOIN links ON x = r)
SELECT d AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id, d = min(r) AS kept FROM reached LEFT JOIN n ON doc_id = d GROUP BY d
""")
def op6(spark, sf_dir):
    return near_dups.groups(table(spark, sf_dir, "documents"))
