"""Query 13."""

from . import prefix_trie
from .common import table
from .registry import query
from .sql import crc32

_SQL = f"""
WITH o AS MATERIALIZED (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 30)) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS MATERIALIZED (SELECT conv_id, CAST({crc32("CAST(conv_id AS VARCHAR)")} % 6 AS BIGINT) AS h, conv_id - conv_id % 100 AS base FROM (SELECT DISTINCT conv_id FROM o)),
r AS MATERIALIZED (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY side, pos) AS depth FROM (
    SELECT c.conv_id, role, text, pos, 0 AS side FROM c JOIN o ON o.conv_id = c.base WHERE pos <= h
    UNION ALL SELECT c.conv_id, role, text, pos, 1 FROM c JOIN o ON o.conv_id = c.conv_id WHERE pos > h)
), s AS MATERIALIZED (
  SELECT conv_id, depth, length(text) AS chars, sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS k FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
), e AS (SELECT conv_id, max(depth) AS len FROM s GROUP BY 1),
m AS MATERIALIZED (SELECT s.*, len, min(s.conv_id) OVER (PARTITION BY depth, k) AS node FROM s JOIN e USING (conv_id)),
u AS MATERIALIZED (SELECT a.*, b.node AS parent FROM m a LEFT JOIN m b ON b.conv_id = a.conv_id AND b.depth = a.depth - 1),
t AS MATERIALIZED (
  SELECT node, depth, min(parent) AS parent, count(*) AS n_convs, (count(*) - 1) * max(chars) AS own, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = len), '')) AS ends
  FROM u GROUP BY 1, 2
), k AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n FROM t WHERE depth > 0 GROUP BY 1, 2),
f AS MATERIALIZED (SELECT t.*, coalesce(n, 0) AS n_children FROM t LEFT JOIN k USING (node, depth)),
a AS (SELECT up.node, up.depth, sum(f.own) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves FROM f JOIN m up ON up.conv_id = f.node AND up.depth <= f.depth GROUP BY 1, 2)
SELECT node AS conv_id, CAST(depth AS BIGINT) AS depth, parent AS parent_conv_id, n_convs, n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends AS ends_sha256 FROM f JOIN a USING (node, depth)
"""


@query("op13_prefix_trie", _SQL)
def op13(spark, sf_dir):
    return prefix_trie.nodes(table(spark, sf_dir, "conversations"))
