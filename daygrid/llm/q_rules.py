"""Queries on built-in functions alone: quality rules, secrets."""

from __future__ import annotations

from pyspark.sql import functions as F

from daygrid.llm import divergence_rules, secret_owners, shared
from daygrid.llm.catalog import query

WORDS = "list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_CLASSES = {k: f"LENGTH(t) - LENGTH(regexp_replace(t, '[{v.replace(chr(39), chr(39) * 2)}]', '', 'g'))" for k, v in divergence_rules.CLASSES.items()}
_SIZE = len(divergence_rules.COMMON["en"])
_LISTED = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in divergence_rules.COMMON.items())


def _distance(a: str, b: str) -> str:
    return f"""CASE WHEN list_sum({a}) > 0 AND list_sum({b}) > 0 THEN SQRT(GREATEST(0.0, list_sum(list_transform(range(1, LEN({a}) + 1), lambda i:
      (CASE WHEN {a}[i] > 0 THEN {a}[i]/list_sum({a})*LOG2(2*({a}[i]/list_sum({a}))/({a}[i]/list_sum({a}) + {b}[i]/list_sum({b}))) ELSE 0.0 END
      + CASE WHEN {b}[i] > 0 THEN {b}[i]/list_sum({b})*LOG2(2*({b}[i]/list_sum({b}))/({a}[i]/list_sum({a}) + {b}[i]/list_sum({b}))) ELSE 0.0 END)/2)))) END"""


RULES_SQL = f"""
WITH docs AS (SELECT doc_id, lang, COALESCE(text, '') AS t FROM documents),
split AS MATERIALIZED (SELECT *, {WORDS} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
  CASE lang {_LISTED} END AS listed FROM docs),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS eight FROM (SELECT doc_id, w, UNNEST(range(1, LEN(w) - 6)) AS i FROM split WHERE LEN(w) >= 8) AS a),
twice AS (SELECT doc_id, eight FROM windows GROUP BY 1, 2 HAVING COUNT(*) > 1),
covered AS (SELECT doc_id, COUNT(DISTINCT i + d) AS n FROM windows JOIN twice USING (doc_id, eight) CROSS JOIN (SELECT UNNEST(range(0, 8)) AS d) AS e GROUP BY 1),
counts AS MATERIALIZED (SELECT s.doc_id, lang, LEN(w) AS n_words, LENGTH(array_to_string(w, '')) AS word_chars, LENGTH(t) - LENGTH(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  LEN(lines) - LEN(list_distinct(lines)) AS n_dup_lines, COALESCE(n, 0) AS n_repeat_words,
  list_transform([{', '.join(_CLASSES.values())}, LENGTH(t) - ({' + '.join(f'({v})' for v in _CLASSES.values())})], lambda x: x::DOUBLE) AS classes,
  CASE WHEN listed IS NOT NULL THEN list_transform(range(1, {_SIZE + 2}), lambda k: CASE WHEN k <= {_SIZE} THEN LEN(list_filter(w, lambda x: x = listed[k]))
    ELSE LEN(list_filter(w, lambda x: NOT list_contains(listed, x))) END::DOUBLE) END AS common
  FROM split AS s LEFT JOIN covered AS c ON c.doc_id = s.doc_id),
reference AS (SELECT lang, [{', '.join(f'SUM(classes[{k}])' for k in range(1, len(_CLASSES) + 2))}] AS rc,
  [{', '.join(f'COALESCE(SUM(common[{k}]), 0)' for k in range(1, _SIZE + 2))}] AS rw FROM counts WHERE lang IS NOT NULL GROUP BY lang),
far AS (SELECT c.*, {_distance('classes', 'rc')} AS dc, {_distance('common', 'rw')} AS dw FROM counts AS c LEFT JOIN reference AS r ON r.lang = c.lang)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
 bad AS base_failed, NOT bad AND NOT (word_chars >= {divergence_rules.MIN_CHARS} AND COALESCE(dc > {divergence_rules.MAX_CLASS_DISTANCE}, FALSE)
  OR n_words >= {divergence_rules.MIN_COMMON_WORDS} AND COALESCE(dw > {divergence_rules.MAX_WORD_DISTANCE}, FALSE)) AS kept,
 FLOOR(dc*10000 + 0.5)/10000 AS class_distance, FLOOR(dw*10000 + 0.5)/10000 AS word_distance
FROM (SELECT *, n_words < 20 OR 100*n_repeat_words > 30*n_words AS bad FROM far) AS x"""


@query("op9_divergence_rules", RULES_SQL)
def rules(spark, sf_dir):
    found = divergence_rules.judged(shared.table(spark, sf_dir, "documents")).drop("lang")
    rounded = {c: F.floor(F.col(c) * 10000 + 0.5) / 10000 for c in ("class_distance", "word_distance")}
    return found.withColumns(rounded)


def _matched(kind: int) -> str:
    pattern = secret_owners.PATTERNS[kind].replace("'", "''")
    fits = {0: "LENGTH(v) >= 6", 3: "regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9].*[0-9]')"
            f" OR LEN(regexp_extract_all(v, '{secret_owners.TURN}')) >= {secret_owners.LEAST_TURNS}"}.get(kind, "TRUE")
    return f"""SELECT doc_id, source, {kind} AS kind, b - LENGTH(h) AS a, b, MD5(v) AS v FROM (
  SELECT doc_id, source, hits[i] AS h, vals[i] AS v, (list_sum(list_transform(gaps[1:i], lambda x: LENGTH(x))) + list_sum(list_transform(hits[1:i], lambda x: LENGTH(x))))::BIGINT AS b FROM (
   SELECT *, UNNEST(range(1, LEN(hits) + 1)) AS i FROM (SELECT doc_id, source, regexp_split_to_array(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS hits,
    regexp_extract_all(t, '{pattern}', {2 if kind == 0 else 0}) AS vals FROM docs WHERE regexp_matches(t, '{pattern}')) AS m) AS n) AS o WHERE {fits}"""


SECRETS_SQL = f"""
WITH docs AS (SELECT doc_id, source, COALESCE(text, '') AS t FROM documents),
matched AS MATERIALIZED ({' UNION ALL '.join(map(_matched, range(4)))}),
apart AS (SELECT * FROM matched AS m WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM matched AS o WHERE o.doc_id = m.doc_id AND o.kind < 3 AND o.a <= m.a AND m.b <= o.b)),
owners AS (SELECT v, COUNT(DISTINCT source) >= {secret_owners.WIDE_OWNERS} AS copied, COUNT(DISTINCT source) AS n_owner, COUNT(DISTINCT doc_id) AS n_repository FROM apart GROUP BY v),
spans AS (SELECT doc_id, kind, a, b, copied, n_owner, n_repository, (['assign', 'access', 'hex', 'owned'])[kind + 1] || ':' || a || ':' || b AS told FROM apart JOIN owners USING (v) WHERE kind < 3 OR NOT copied),
per_doc AS (SELECT doc_id, COUNT(*) FILTER (kind = 0) AS n_assign, COUNT(*) FILTER (kind = 1) AS n_access, COUNT(*) FILTER (kind = 2) AS n_hex, COUNT(*) FILTER (kind = 3) AS n_owned,
  COUNT(*) FILTER (NOT copied) AS n_live, COUNT(*) FILTER (copied) AS n_copied, MAX(n_repository) AS most_repositories, MAX(n_owner) AS most_owners, STRING_AGG(told, ',' ORDER BY a, kind) AS spans,
  STRING_AGG(told, ',' ORDER BY a, kind) FILTER (kind < 3) AS base FROM spans GROUP BY doc_id)
SELECT d.doc_id, COALESCE(n_assign, 0) AS n_assign, COALESCE(n_access, 0) AS n_access, COALESCE(n_hex, 0) AS n_hex, SHA256(COALESCE(base, '')) AS base_sha256,
 COALESCE(spans, '') AS spans, COALESCE(n_owned, 0) AS n_owned, COALESCE(n_live, 0) AS n_live, COALESCE(n_copied, 0) AS n_copied,
 COALESCE(most_repositories, 0) AS most_repositories, COALESCE(most_owners, 0) AS most_owners
FROM docs AS d LEFT JOIN per_doc USING (doc_id)"""


@query("op10_secret_owners", SECRETS_SQL)
def secrets(spark, sf_dir):
    found = secret_owners.judged(shared.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_owned", "n_live", "n_copied",
                        "most_repositories", "most_owners")
