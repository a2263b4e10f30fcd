"""Query: near duplicates."""

from __future__ import annotations

from daygrid.llm import minhash_dedup, shared
from daygrid.llm.catalog import query
from daygrid.llm.url_markov import LOWER, UPPER

DEDUP_SQL = f"""
WITH RECURSIVE split AS (SELECT doc_id, list_filter(regexp_split_to_array(TRANSLATE(COALESCE(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS MATERIALIZED (SELECT DISTINCT doc_id, HASH(s) AS s FROM (
  SELECT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, UNNEST(range(1, GREATEST(LEN(w) - 1, 2))) AS i FROM split WHERE LEN(w) > 0) AS a) AS b),
sizes AS MATERIALIZED (SELECT doc_id, COUNT(*) AS n FROM shingles GROUP BY 1),
links AS MATERIALIZED (SELECT c.a, c.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, COUNT(*) AS k FROM shingles AS x JOIN shingles AS y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) AS c
  JOIN sizes AS p ON p.doc_id = c.a JOIN sizes AS q ON q.doc_id = c.b WHERE 100*k >= 85*(p.n + q.n - k)),
reach AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT r.node, l.b FROM reach AS r JOIN links AS l ON l.a = r.other)
SELECT d.doc_id, COALESCE(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents AS d LEFT JOIN sizes USING (doc_id)
 JOIN (SELECT node, MIN(other) AS component_id FROM reach GROUP BY 1) AS c ON c.node = d.doc_id"""


@query("op6_minhash_dedup", DEDUP_SQL)
def dedup(spark, sf_dir):
    return minhash_dedup.near_duplicates(shared.table(spark, sf_dir, "documents"), words=3, percent=85)
