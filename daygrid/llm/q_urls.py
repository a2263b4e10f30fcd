"""Query: URL filter."""

from __future__ import annotations

from pyspark.sql import functions as F

from daygrid.llm import shared, url_markov
from daygrid.llm.catalog import query

_FITS = " ".join(f"WHEN (host = '{r[:r.index('/')]}' OR ends_with(host, '.{r[:r.index('/')]}')) AND starts_with(path, '{r[r.index('/'):]}') THEN {{{k}}}"
                 for k, r in enumerate(sorted((r for r, _ in url_markov.RULES), key=len, reverse=True)))
_SORTED = sorted(url_markov.RULES, key=lambda r: -len(r[0]))
RULE = "CASE " + _FITS.format(*[f"'{r}'" for r, _ in _SORTED]) + " END"
SAID = "CASE " + _FITS.format(*[f"'{v}'" for _, v in _SORTED]) + " END"
_SEEDED = f"regexp_matches(host, '(^|[^a-z])({'|'.join(url_markov.SEEDS)})([^a-z]|$)')"
_FOLDS = range(url_markov.FOLDS)
_SIDES = ["rejected", *[f"{kind}{k}" for kind in ("rejected", "accepted") for k in _FOLDS]]


def _chance(side: str) -> str:
    out = "0.01::DOUBLE"
    for n in range(url_markov.ORDER + 1):
        out = f"CASE WHEN h{n}.{side}_all > 0 THEN (g{n}.{side} + h{n}.{side}_kinds*({out}))/(h{n}.{side}_all + h{n}.{side}_kinds) ELSE {out} END"
    return out


_LEVELS = "".join(f"""
l{n} AS (SELECT RIGHT(gram, {n + 1}) AS g, {', '.join(f'SUM({x})::DOUBLE AS {x}' for x in _SIDES)} FROM grams GROUP BY 1),
m{n} AS (SELECT LEFT(g, {n}) AS h, {', '.join(f'SUM({x}) AS {x}_all, COUNT(*) FILTER ({x} > 0) AS {x}_kinds' for x in _SIDES)} FROM l{n} GROUP BY 1),"""
                  for n in range(url_markov.ORDER + 1))
_JOINS = " ".join(f"JOIN l{n} AS g{n} ON g{n}.g = RIGHT(gram, {n + 1}) JOIN m{n} AS h{n} ON h{n}.h = LEFT(g{n}.g, {n})" for n in range(url_markov.ORDER + 1))
URLS_SQL = f"""
WITH parts AS (SELECT page_id, CASE WHEN contains(COALESCE(url, ''), '://') THEN SUBSTRING(url, INSTR(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, TRANSLATE(regexp_extract(rest, '^[^/?#]*'), '{url_markov.UPPER}', '{url_markov.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
ruled AS MATERIALIZED (SELECT *, {RULE} AS rule, {SAID} AS said, regexp_replace(host || LOWER(path), '[0-9]+', '0', 'g') AS s FROM parsed),
texts AS MATERIALIZED (SELECT *, INSTR('0123456789abcdef', LEFT(MD5(string_split(s, '/')[1]), 1)) % {url_markov.FOLDS} AS fold FROM (
  SELECT s, COUNT(*) FILTER ({_SEEDED}) AS rejected, COUNT(*) FILTER (NOT ({_SEEDED}) AND said IS DISTINCT FROM 'block') AS accepted FROM ruled WHERE s <> '' GROUP BY s) AS t),
placed AS MATERIALIZED (SELECT s, fold, rejected, accepted, SUBSTRING(REPEAT(CHR(2), {url_markov.ORDER}) || s || CHR(3), i::BIGINT, {url_markov.ORDER + 1}) AS gram FROM (
  SELECT *, UNNEST(range(1, LENGTH(s) + 2)) AS i FROM texts) AS t),
grams AS MATERIALIZED (SELECT gram, SUM(rejected) AS rejected, {', '.join(f'SUM(CASE WHEN fold <> {k} THEN {kind} ELSE 0 END) AS {kind}{k}' for kind in ('rejected', 'accepted') for k in _FOLDS)} FROM placed GROUP BY 1),{_LEVELS}
ratios AS MATERIALIZED (SELECT gram, [{', '.join(f"LOG2({_chance('rejected')}) - LOG2({_chance(f'accepted{k}')})" for k in _FOLDS)}] AS ratio,
 [{', '.join(f"LOG2({_chance(f'rejected{k}')}) - LOG2({_chance(f'accepted{k}')})" for k in _FOLDS)}] AS apart FROM grams {_JOINS}),
scores AS MATERIALIZED (SELECT s, rejected, accepted, ROUND(AVG(ratio[fold + 1]), 9) AS score, ROUND(AVG(apart[fold + 1]), 9) AS held FROM placed JOIN ratios USING (gram) GROUP BY 1, 2, 3),
steps AS (SELECT FLOOR(held/{url_markov.GRID}) AS step, SUM(accepted) AS a, SUM(rejected) AS r FROM scores GROUP BY 1),
upto AS (SELECT step, 2*SUM(a) OVER (ORDER BY step) >= SUM(a) OVER () AS ua, 2*SUM(r) OVER (ORDER BY step) >= SUM(r) OVER () AS ur FROM steps),
edge AS (SELECT GREATEST((MIN(step) FILTER (ua) + MIN(step) FILTER (ur))*{url_markov.GRID}/2, 0) AS edge FROM upto),
both_kinds AS (SELECT COALESCE(BOOL_OR(rejected > 0) AND BOOL_OR(accepted > 0), FALSE) AS ok FROM scores)
SELECT page_id, host, path, rule, COALESCE(said, CASE WHEN ok AND score >= edge AND score > 0 THEN 'block' ELSE 'allow' END) AS verdict, FLOOR(score*1000 + 0.5)/1000 AS score
FROM ruled LEFT JOIN (SELECT s, score FROM scores) AS x USING (s) CROSS JOIN edge CROSS JOIN both_kinds"""


@query("op8_url_markov", URLS_SQL)
def urls(spark, sf_dir):
    return url_markov.judged(shared.table(spark, sf_dir, "pages")).withColumn("score", F.floor(F.col("score") * 1000 + 0.5) / 1000)
