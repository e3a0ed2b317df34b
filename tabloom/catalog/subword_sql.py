"""Byte-level subwords in plain SQL: pieces cut without look-ahead, then pairs joined by recursion over distinct pieces."""

from __future__ import annotations

from tabloom.catalog.fixtures import SUBWORD_FILE


def subword_ids(source: str, key: str) -> str:
    """CTEs that end in ``subword_rows``: ``key, text, ids`` of every row of ``source``, which has ``key`` and ``text``.

    White space comes as single characters first. All but the last one before a word or sign are a piece; the last one is a piece
    of its own unless it is a blank, which belongs to what follows.
    """
    return f"""
WITH RECURSIVE ranks AS (
  SELECT hex(from_base64(split_part(line, ' ', 1))) AS token, CAST(split_part(line, ' ', 2) AS BIGINT) AS id
  FROM read_csv('{SUBWORD_FILE}', header = false, columns = {{'line': 'VARCHAR'}}, delim = chr(9), quote = '', escape = '')
),
given AS (SELECT *, row_number() OVER () AS row_id FROM ({source})),
cut AS (
  SELECT row_id, unnest(p) AS piece, generate_subscripts(p, 1) AS pos
  FROM (SELECT row_id, regexp_extract_all(text, '''s|''t|''re|''ve|''m|''ll|''d| ?\\pL+| ?\\pN+| ?[^\\s\\pL\\pN]+|\\s') AS p FROM given)
),
runs AS (
  SELECT *, regexp_full_match(piece, '\\s') AS blank, lead(piece) OVER (PARTITION BY row_id ORDER BY pos) AS following,
    pos - row_number() OVER (PARTITION BY row_id, regexp_full_match(piece, '\\s') ORDER BY pos) AS run
  FROM cut
),
grouped AS (
  SELECT row_id, min(pos) AS pos, string_agg(piece, '' ORDER BY pos) AS piece, arg_max(following, pos) AS following, any_value(blank) AS blank
  FROM runs GROUP BY row_id, blank, CASE WHEN blank THEN run ELSE pos END
),
parted AS (
  SELECT *, blank AND length(piece) > 1 AND following IS NOT NULL AND following[1] <> ' ' AS apart FROM grouped
),
pieces AS (
  SELECT row_id, pos, 0 AS part, CASE WHEN apart THEN left(piece, -1) ELSE piece END AS piece FROM parted
  UNION ALL SELECT row_id, pos, 1, right(piece, 1) FROM parted WHERE apart
),
steps AS (
  SELECT piece, list_transform(range(0, octet_length(encode(piece))), lambda i: substr(hex(encode(piece)), 2 * i + 1, 2)) AS parts
  FROM (SELECT DISTINCT piece FROM pieces)
  UNION ALL
  SELECT piece, list_concat(list_append(parts[:best - 1], parts[best] || parts[best + 1]), parts[best + 2:])
  FROM (
    SELECT piece, any_value(parts) AS parts, arg_min(i, (id, i)) AS best
    FROM (SELECT piece, parts, unnest(range(1, len(parts))) AS i FROM steps) s JOIN ranks r ON r.token = s.parts[s.i] || s.parts[s.i + 1]
    GROUP BY piece
  )
),
done AS (SELECT piece, arg_min(parts, len(parts)) AS parts FROM steps GROUP BY piece),
piece_ids AS (
  SELECT piece, list(id ORDER BY i) AS ids
  FROM (SELECT piece, unnest(parts) AS token, generate_subscripts(parts, 1) AS i FROM done) JOIN ranks USING (token) GROUP BY piece
),
row_ids AS (
  SELECT row_id, flatten(list(ids ORDER BY pos, part)) AS ids FROM pieces JOIN piece_ids USING (piece) GROUP BY row_id
),
subword_rows AS (SELECT {key}, text, coalesce(ids, []) AS ids FROM given LEFT JOIN row_ids USING (row_id))
"""
