"""Query 12."""

from . import lang_id
from .common import table
from .registry import query
from .sql import crc32

_SQL = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce({crc32("CAST(doc_id AS VARCHAR)")} % 4, 0) = 2 AS held_out,
    ' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{M}}]+'), ' ') || ' ' AS s, regexp_matches(lower(coalesce(text, '')), '\\p{{L}}') AS lettered
  FROM documents
), p AS (SELECT r, i, c FROM (SELECT r, unnest(string_split(s, '')) AS c, generate_subscripts(string_split(s, ''), 1) AS i FROM d WHERE lettered)),
t AS (SELECT r, c AS a, lead(c) OVER w AS b, lead(c, 2) OVER w AS c FROM p WINDOW w AS (PARTITION BY r ORDER BY i)),
g AS MATERIALIZED (
  SELECT r, gram, count(*) AS n FROM (
    SELECT r, a AS gram FROM t WHERE a <> ' ' UNION ALL SELECT r, a || b FROM t WHERE b IS NOT NULL UNION ALL SELECT r, a || b || c FROM t WHERE c IS NOT NULL AND b <> ' '
  ) GROUP BY 1, 2
), own AS MATERIALIZED (SELECT * FROM (SELECT r, gram, row_number() OVER (PARTITION BY r ORDER BY n DESC, gram) - 1 AS place FROM g) WHERE place < 300),
learned AS MATERIALIZED (
  SELECT * FROM (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, gram) - 1 AS place FROM g JOIN d USING (r) WHERE NOT held_out AND lang IS NOT NULL GROUP BY 1, 2) WHERE place < 300
), langs AS (SELECT DISTINCT lang FROM learned),
apart AS (
  SELECT r, langs.lang, CAST(sum(CASE WHEN l.place IS NULL THEN 300 ELSE abs(l.place - own.place) END) AS BIGINT) AS distance, count(*) AS n_grams
  FROM own CROSS JOIN langs LEFT JOIN learned l ON l.lang = langs.lang AND l.gram = own.gram GROUP BY 1, 2
), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY distance, lang) AS k FROM apart) WHERE k = 1),
sizes AS (SELECT r, count(*) AS m FROM own GROUP BY 1)
SELECT doc_id, held_out, coalesce(best.lang, 'und') AS lang_pred, CASE WHEN best.r IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - distance::DOUBLE / (n_grams * 300)::DOUBLE END AS score,
  coalesce(distance, m * 300, 0) AS distance, coalesce(n_grams, m, 0) AS n_grams
FROM d LEFT JOIN best USING (r) LEFT JOIN sizes USING (r)
"""


@query("op12_lang_id", _SQL)
def op12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return lang_id.classify(docs, lang_id.train(docs))
