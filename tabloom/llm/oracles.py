"""SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from tabloom.llm.common import LOWER, UPPER

LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
BLANK_WORDS = rf"regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+')"
PLAIN_WORDS = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {}
ORACLES["op2_near_duplicates"] = f"""
WITH RECURSIVE listed AS MATERIALIZED (SELECT doc_id, {BLANK_WORDS} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM listed WHERE len(w) > 0),
shingles AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS shingle FROM starts),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
),
links AS MATERIALIZED (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)
),
ways AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, b.y FROM reached r JOIN ways b ON b.x = r.other
),
least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, l.component_id = d.doc_id AS kept
FROM documents d JOIN least l ON l.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""
ORACLES["op7_decontamination"] = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {PLAIN_WORDS} AS w FROM benchmark),
cut AS (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0),
windows AS MATERIALIZED (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(list_slice(w, i, i + 9), ' ') AS terms FROM cut
),
listed AS MATERIALIZED (SELECT doc_id, {PLAIN_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM listed, sizes WHERE len(w) >= size),
hits AS MATERIALIZED (
  SELECT p.doc_id, p.i, p.size, v.item, v.terms
  FROM places p JOIN windows v ON v.size = p.size AND v.terms = array_to_string(list_slice(p.w, p.i, p.i + p.size - 1), ' ')
),
covered AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS at_word FROM hits) GROUP BY doc_id
),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id),
offsets AS MATERIALIZED (
  SELECT terms, unnest(string_split(terms, ' ')) AS term, generate_subscripts(string_split(terms, ' '), 1) AS off FROM (SELECT DISTINCT terms FROM windows)
),
words AS MATERIALIZED (
  SELECT doc_id, pos, term FROM (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM listed) WHERE term IN (SELECT term FROM offsets)
),
ranked AS (
  SELECT o.terms, o.off, o.term, row_number() OVER (PARTITION BY o.terms ORDER BY f.found, o.off, o.term) AS place
  FROM offsets o JOIN (SELECT term, count(*) AS found FROM words GROUP BY term) f ON f.term = o.term
),
placed AS MATERIALIZED (
  SELECT DISTINCT w.doc_id, r.terms, r.place, w.pos - r.off AS start FROM words w JOIN ranked r ON r.term = w.term WHERE r.place <= 2
),
near AS (
  SELECT DISTINCT a.doc_id, a.terms
  FROM placed a JOIN placed b ON b.doc_id = a.doc_id AND b.terms = a.terms AND a.place = 1 AND b.place = 2 AND abs(b.start - a.start) <= 5
  WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.doc_id = a.doc_id AND h.terms = a.terms)
),
beside AS (SELECT doc_id, count(*) AS n_near FROM near GROUP BY doc_id)
SELECT l.doc_id, CAST(len(l.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
  sha256(coalesce(n.items, '')) AS items_sha256, c.n_hit IS NOT NULL AS contaminated, coalesce(b.n_near, 0) AS n_near
FROM listed l LEFT JOIN covered c ON c.doc_id = l.doc_id LEFT JOIN named n ON n.doc_id = l.doc_id LEFT JOIN beside b ON b.doc_id = l.doc_id
"""
