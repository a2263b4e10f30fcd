"""Queries: nearest neighbours, mixing."""

from __future__ import annotations

from daygrid.llm import ann_graph, poisson_mix, shared
from daygrid.llm.catalog import query


@query("op1_ann_graph")
def neighbours(spark, sf_dir):
    return ann_graph.nearest(shared.table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", 5)


_LARGE = f"SELECT d.*, rate FROM drawn AS d JOIN rates AS p ON p.source IS NOT DISTINCT FROM d.source WHERE rate > {poisson_mix.LARGE}"
for _name, _step in poisson_mix.large_steps("u", "rate"):
    _LARGE = f"SELECT *, {_step} AS {_name} FROM ({_LARGE}) AS x"
MIX_SQL = f"""
WITH sums AS (SELECT source, SUM(COALESCE(LENGTH(text), 0))::DOUBLE AS chars FROM documents GROUP BY source),
rates AS (SELECT source, CASE WHEN chars > 0 THEN 1.0::DOUBLE / (SELECT COUNT(*) FROM sums) * 1.0::DOUBLE * (SELECT SUM(chars) FROM sums) / chars ELSE 1.0::DOUBLE END AS rate FROM sums),
terms AS (SELECT source, rate, k, -rate + COALESCE(SUM(CASE WHEN k > 0 THEN LN(rate) - LN(GREATEST(k, 1)) END) OVER (PARTITION BY source ORDER BY k), 0) AS l
  FROM rates, UNNEST(GENERATE_SERIES(0, CEIL(rate + 12 * SQRT(rate) + 24)::INT)) AS t(k) WHERE rate <= {poisson_mix.LARGE}),
upto AS (SELECT source, SUM(EXP(l)) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
drawn AS (SELECT *, ('0x' || SUBSTRING(MD5('20:count:' || COALESCE(doc_id::VARCHAR, 'text:' || COALESCE(text, ''))), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM documents),
counted AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, COUNT(*) AS n FROM drawn AS d JOIN upto AS p ON p.source IS NOT DISTINCT FROM d.source AND p.c <= d.u GROUP BY ALL
  UNION ALL SELECT doc_id, text, lang, source, n_chars, __k AS n FROM ({_LARGE}) AS large)
SELECT doc_id, text, lang, source, n_chars, copy::BIGINT AS copy, MD5('20:order:' || COALESCE(doc_id::VARCHAR, 'text:' || COALESCE(text, '')) || ':' || copy::VARCHAR) AS order_key
FROM counted, UNNEST(GENERATE_SERIES(1, n)) AS t(copy)"""


@query("op3_poisson_mix", MIX_SQL)
def mix(spark, sf_dir):
    """All sources in equal shares, as many characters as there are."""
    return poisson_mix.mixed(shared.table(spark, sf_dir, "documents"))
