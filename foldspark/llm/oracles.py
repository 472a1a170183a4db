"""SQL that gives the rows of the queries that SQL can express."""

from __future__ import annotations

from . import jaccard_join, licences, mixing


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _rows(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(_text(x) if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


_NOTICES = [(t, label, i, word) for t, (label, notice, _) in enumerate(licences.TEMPLATES) for i, word in enumerate(notice)]
_PHRASES = [(t, phrase) for t, (_, _, phrases) in enumerate(licences.TEMPLATES) for phrase in phrases]
_BASE = [(phrase, label, len(phrase.split())) for phrase, label in licences.BASE.items()]

LICENCES = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w
  FROM documents),
s AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS spaced FROM d),
words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
base(phrase, label, size) AS (VALUES {_rows(_BASE)}),
places AS (
  SELECT s.rid, base.label, unnest(list_filter(range(len(w)), lambda i: array_to_string(w[i + 1:i + size], ' ') = phrase)) AS i
  FROM s, base WHERE contains(spaced, ' ' || phrase || ' ')),
based AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS found FROM places GROUP BY rid),
notice(t, label, place, word) AS (VALUES {_rows(_NOTICES)}),
phrase(t, phrase) AS (VALUES {_rows(_PHRASES)}),
vocabulary AS (SELECT DISTINCT word FROM notice),
counted AS (
  SELECT v.word, ln((SELECT count(*) + 1 FROM d) / (count(DISTINCT words.rid) + 1)) + 1e-6 AS idf
  FROM vocabulary v LEFT JOIN words USING (word) GROUP BY v.word),
rare AS (
  SELECT t, label, word, place, idf FROM (
    SELECT t, label, word, min(place) AS place, idf, row_number() OVER (PARTITION BY t ORDER BY idf DESC, word) AS n
    FROM notice JOIN counted USING (word) GROUP BY t, label, word, idf) WHERE n <= {licences.RARE}),
votes AS (
  SELECT rid, t, label, words.i - rare.place AS begins, sum(rare.idf) AS x
  FROM words JOIN rare USING (word) GROUP BY ALL),
candidates AS (
  SELECT rid, t, label, least(max(x) / (SELECT sum(idf) FROM rare r WHERE r.t = votes.t), 1.0) AS share FROM votes GROUP BY rid, t, label),
verified AS (
  SELECT rid, label, share FROM candidates JOIN s USING (rid)
  WHERE share >= {licences.SHARE} - 1e-12 AND (SELECT bool_and(contains(spaced, ' ' || p.phrase || ' ')) FROM phrase p WHERE p.t = candidates.t)),
method AS (SELECT rid, list(DISTINCT label) AS found, max(share) AS score FROM verified GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  array_to_string(list_sort(coalesce(b.found, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.found, []), coalesce(m.found, [])))), ',') AS labels, round(coalesce(score, 0.0), 6) AS score
FROM s LEFT JOIN based b USING (rid) LEFT JOIN method m USING (rid)
"""

JACCARD = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM d),
records AS (SELECT s, row_number() OVER () AS k, min(doc_id) AS rep, count(*) AS copies, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
shingles AS (SELECT k, n, unnest(s) AS g FROM records),
links AS (
  SELECT a.k AS a, b.k AS b FROM shingles a JOIN shingles b ON a.g = b.g AND a.k < b.k
  GROUP BY a.k, b.k, a.n, b.n HAVING count(*) >= {jaccard_join.THRESHOLD} * (a.n + b.n - count(*)) - 1e-9),
pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(k, r) AS (SELECT k, k FROM records UNION SELECT reached.k, pairs.b FROM reached JOIN pairs ON pairs.a = reached.r),
classes AS (SELECT reached.k, min(other.rep) AS class_id FROM reached JOIN records other ON other.k = reached.r GROUP BY reached.k),
degrees AS (SELECT a AS k, count(*) AS n_links FROM pairs GROUP BY a)
SELECT sets.doc_id, CASE WHEN r.k IS NULL THEN sets.doc_id ELSE c.class_id END AS class_id, CASE WHEN r.k IS NULL THEN sets.doc_id ELSE r.rep END AS copy_id,
  CAST(coalesce(r.copies, 1) AS BIGINT) AS n_copies, CAST(coalesce(g.n_links, 0) AS BIGINT) AS n_links
FROM sets LEFT JOIN records r ON r.s = sets.s LEFT JOIN classes c USING (k) LEFT JOIN degrees g USING (k)
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_jaccard_join": JACCARD, "op8_licences": LICENCES, "op10_mix_sources": mixing.OP10_SQL}
