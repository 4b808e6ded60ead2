"""DuckDB SQL of the queries that SQL can express over whole tables."""

from tallyforge.llm.line_dedup import MIN_CHARS, MIN_DOCUMENTS
from tallyforge.llm.quality_rules import MAX_DOCUMENTS, MAX_REMOVED_PERCENT

_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP6 = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM d WHERE len(w) >= 5),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) > 1 AS yes FROM windows),
positions AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i FROM d),
covered AS (
  SELECT positions.doc_id, max(coalesce(yes, false)) OVER (PARTITION BY positions.doc_id ORDER BY positions.i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS yes
  FROM positions LEFT JOIN twice ON positions.doc_id = twice.doc_id AND positions.i = twice.i),
repeats AS (SELECT doc_id, count(*) FILTER (WHERE yes) AS n FROM covered GROUP BY doc_id),
raw_lines AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d),
lines AS (SELECT *, {_WORDS.format("line")} AS w FROM raw_lines),
filled AS (
  SELECT doc_id, source, text, len(w) AS words, regexp_replace(lower(array_to_string(w, ' ')), '[0-9]', '0', 'g') AS key,
    row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS nth
  FROM lines WHERE len(w) > 0),
dups AS (SELECT doc_id, count(*) FILTER (WHERE nth > 1) AS n FROM filled GROUP BY doc_id),
frequent AS (SELECT source, key, min(doc_id) AS first FROM filled GROUP BY source, key HAVING count(DISTINCT text) > {MAX_DOCUMENTS}),
cut AS (SELECT filled.doc_id, sum(words) AS n FROM filled JOIN frequent ON filled.source = frequent.source AND filled.key = frequent.key WHERE filled.doc_id <> first GROUP BY filled.doc_id),
s AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dups.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, coalesce(cut.n, 0) AS removed_words
  FROM d LEFT JOIN repeats USING (doc_id) LEFT JOIN dups USING (doc_id) LEFT JOIN cut USING (doc_id)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, 100 * removed_words > {MAX_REMOVED_PERCENT} * n_words AS depleted FROM s)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT depleted AS kept, CAST(removed_words AS BIGINT) AS removed_words, depleted
FROM v
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM d),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS node, doc_id AS target FROM documents UNION SELECT node, y FROM reach JOIN edges ON target = x)
SELECT node AS doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(target) AS component_id
FROM reach LEFT JOIN sizes ON sizes.doc_id = node GROUP BY node, n
"""

OP11 = f"""
WITH raw_lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
lines AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM raw_lines),
shared AS (SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCUMENTS})
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE last > doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE last IS NULL OR last <= doc_id), '')) AS kept_sha256
FROM lines LEFT JOIN shared USING (key) GROUP BY doc_id
"""

ORACLE_SQL = {"op6_quality_rules": OP6, "op9_jaccard_join": OP9, "op11_line_dedup": OP11}
