"""SQL of the corpus queries that SQL can express in full, for DuckDB."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: All pairs that share a shingle, counted, and the documents reachable by links. For small tables.
OP5 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_WORD}+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE list_distinct([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) END AS ss FROM w
), x AS (
  SELECT doc_id, len(ss) AS n, unnest(ss) AS shingle FROM s
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs WHERE 100 * c >= 80 * (na + nb - c)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS d, doc_id AS r FROM documents
  UNION
  SELECT reach.d, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a
), least AS (
  SELECT d, min(r) AS component_id FROM reach GROUP BY d
)
SELECT s.doc_id, len(s.ss)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN least ON least.d = s.doc_id
"""

#: With a floor of one word a line goes if a run from it to the nearest line with a word, on either side, stands
#: earlier: a line with a word is such a run itself, and any later copy of a run that holds a blank line and a word
#: holds one of these.
OP9 = f"""
WITH d AS (
  SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, ls, i, regexp_matches(ls[i], '{_WORD}') AS word FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)
), near AS (
  SELECT doc_id, ls, i,
    min(CASE WHEN word THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS following,
    max(CASE WHEN word THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS preceding
  FROM l
), runs AS (
  SELECT doc_id, i AS a, following AS b, array_to_string(ls[i:following], chr(10)) AS run FROM near WHERE following IS NOT NULL
  UNION
  SELECT doc_id, preceding, i, array_to_string(ls[preceding:i], chr(10)) FROM near WHERE preceding IS NOT NULL
), later AS (
  SELECT doc_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, a) AS k FROM runs) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM later
), kept AS (
  SELECT l.doc_id, string_agg(l.ls[l.i], chr(10) ORDER BY l.i) AS t FROM l LEFT JOIN gone USING (doc_id, i) WHERE gone.i IS NULL GROUP BY l.doc_id
), lost AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN lost.n IS NULL THEN d.text ELSE coalesce(kept.t, '') END AS text, len(d.ls)::BIGINT AS n_lines, coalesce(lost.n, 0)::BIGINT AS n_removed,
  lost.n IS NOT NULL AND regexp_matches(coalesce(d.text, ''), '{_WORD}') AND NOT regexp_matches(coalesce(kept.t, ''), '{_WORD}') AS emptied
FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
