"""The queries of this package in DuckDB's SQL, where SQL can express them."""

from __future__ import annotations

LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BENCH_WORDS = "regexp_extract_all(" + LOWERED + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATE = f"""
WITH items AS (SELECT item_id, {BENCH_WORDS.format("text")} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {BENCH_WORDS.format("text")} AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM docs WHERE len(w) > 0),
found AS (
  SELECT doc_id, p, f.n, item_id
  FROM (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS win
        FROM places, (SELECT DISTINCT n FROM windows) WHERE p + n - 1 <= len(w)) f
  JOIN windows USING (win)),
hit AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS spot FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

TEXT_WORDS = "regexp_extract_all(" + LOWERED + ", '[^\\x20\\x09-\\x0D]+')"

JACCARD = f"""
WITH RECURSIVE words AS (SELECT doc_id, coalesce({TEXT_WORDS.format("text")}, []) AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 3], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM shingles x JOIN shingles y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY a, b)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM words UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN sizes USING (doc_id)
"""

LINES = f"""
WITH lines AS (
  SELECT doc_id, i - 1 AS line, l[i] AS content, {TEXT_WORDS.format("l[i]")} AS w
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))),
shingles AS (
  SELECT DISTINCT doc_id, line, hash(array_to_string(w[i:i + 4], ' ')) AS s
  FROM (SELECT doc_id, line, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM lines WHERE len(w) > 0)),
sets AS (SELECT doc_id, line, count(*) AS n, list_sort(list(s)) AS key FROM shingles GROUP BY ALL),
classes AS (SELECT key, n, min((doc_id, line)) AS first FROM sets GROUP BY ALL),
tokens AS (SELECT first, n, unnest(key) AS s FROM classes),
near AS (
  SELECT y.first AS late FROM tokens x JOIN tokens y USING (s) WHERE x.first < y.first
  GROUP BY x.first, y.first, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
kept AS (SELECT first FROM classes WHERE first NOT IN (SELECT late FROM near)),
marked AS (
  SELECT doc_id, line, content, len(w) > 0 AND (doc_id, line) NOT IN (SELECT first FROM kept) AS gone FROM lines),
joined AS (
  SELECT doc_id, coalesce(string_agg(content, chr(10) ORDER BY line) FILTER (NOT gone), '') AS text, count(*) AS n_lines,
         count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line::VARCHAR, ',' ORDER BY line) FILTER (gone), '') AS removed
  FROM marked GROUP BY doc_id)
SELECT doc_id, j.text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed
FROM documents LEFT JOIN joined j USING (doc_id)
"""

PIECES = "string_split_regex(" + LOWERED.format("text") + ", '[.,;:!?\\x0A-\\x0D]')"

COLLOCATIONS = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest({PIECES}) AS piece FROM documents WHERE text IS NOT NULL),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words WHERE len(w) > 0),
sizes AS (SELECT unnest(range(1, 6)) AS size),
f AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS a
      FROM places, sizes WHERE i + size - 1 <= len(w) GROUP BY ALL HAVING size = 1 OR a >= 100),
totals AS (SELECT lang, sum(a)::HUGEINT AS n FROM f WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, a FROM f WHERE size > 1),
cuts AS (
  SELECT c.lang, c.size, c.phrase, c.a, k, l.a AS l, r.a AS r, n, (1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c JOIN totals t ON t.lang = c.lang
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, array_to_string(w[i:j], ' ') AS phrase, max(a) AS a
  FROM (SELECT *, unnest(range(i + 1, len(w) + 1)) AS j FROM (SELECT *, unnest(range(1, len(w))) AS i FROM candidates))
  WHERE j - i + 1 < len(w) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_ x ON x.lang = b.lang AND x.phrase = b.phrase WHERE x.a IS NULL OR 100 * x.a < 100 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""

ORACLES = {"op11_collocations": COLLOCATIONS, "op2_decontaminate": DECONTAMINATE, "op3_jaccard": JACCARD, "op8_line_dedup": LINES}
