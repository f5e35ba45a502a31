"""DuckDB texts of the operators that SQL can express."""

QUALITY = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
grams AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, g) >= 2),
covered AS (
  SELECT rid, sum(least(3, coalesce(nxt - i, 3))) AS n
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM twice) GROUP BY rid),
lines AS (
  SELECT rid, l FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY rid),
normal AS (
  SELECT rid, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS words,
    length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
    regexp_replace(trim(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+', ' ', 'g'), ' '), '[0-9]+', '0', 'g') AS l
  FROM lines),
often AS (
  SELECT d.source, l FROM normal JOIN d USING (rid) GROUP BY d.source, l
  HAVING count(DISTINCT {'i': doc_id, 't': t}) > 20),
gone AS (
  SELECT rid, sum(words) AS words, sum(chars) AS chars, count(*) AS n
  FROM normal JOIN d USING (rid) JOIN often o ON o.l = normal.l AND o.source IS NOT DISTINCT FROM d.source
  GROUP BY rid),
base AS (
  SELECT d.rid, doc_id, len(w.w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS n_frequent_lines,
    len(w.w) - coalesce(gone.words, 0) AS words_left, coalesce(gone.chars, 0) AS gone_chars
  FROM d JOIN w USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN covered USING (rid) LEFT JOIN gone USING (rid))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  n_frequent_lines::BIGINT AS n_frequent_lines, words_left::BIGINT AS words_left,
  (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND words_left >= 50
   AND word_chars - gone_chars >= 0.3 * word_chars) AS kept
FROM base
"""

DECONTAMINATION = r"""
WITH items AS (
  SELECT item_id, w FROM (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS phrase, least(10, len(w)) AS m
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items)),
d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (
  SELECT rid, m, w, unnest(range(1, len(w) - m + 2)) AS i
  FROM d, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m),
hits AS (
  SELECT DISTINCT p.rid, p.i, p.m, x.item_id
  FROM (SELECT rid, i, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM places) p
  JOIN windows x ON x.phrase = p.phrase AND x.m = p.m),
words AS (SELECT rid, count(DISTINCT k) AS n FROM (
  SELECT rid, unnest(range(i, i + m)) AS k FROM (SELECT DISTINCT rid, i, m FROM hits)) GROUP BY rid),
listed AS (
  SELECT rid, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit,
  coalesce(listed.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN listed USING (rid)
"""

LINE_SPREAD = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, text, n_chars, coalesce(source, chr(1)) AS site FROM documents),
split AS (SELECT rid, site, unnest(string_split(text, chr(10))) AS l,
            unnest(range(len(string_split(text, chr(10))))) AS place FROM d),
lines AS (
  SELECT rid, site, place,
    regexp_replace(trim(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+', ' ', 'g'), ' '), '[0-9]+', '0', 'g') AS key
  FROM split WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
spread AS (SELECT key FROM lines GROUP BY key HAVING count(DISTINCT site) >= 5),
marked AS (SELECT lines.*, key IN (SELECT key FROM spread) AS gone FROM lines),
copies AS (SELECT text FROM d WHERE text IS NOT NULL GROUP BY text HAVING count(DISTINCT site) >= 5),
changed AS (
  SELECT rid, sum(CASE WHEN gone THEN 1 ELSE 0 END) AS n FROM marked
  WHERE rid NOT IN (SELECT rid FROM d JOIN copies USING (text)) GROUP BY rid
  HAVING sum(CASE WHEN gone THEN 1 ELSE 0 END) > 0),
kept AS (
  SELECT s.rid, string_agg(s.l, chr(10) ORDER BY s.place) AS text
  FROM split s JOIN changed c USING (rid) LEFT JOIN marked m ON m.rid = s.rid AND m.place = s.place
  WHERE NOT coalesce(m.gone, false) GROUP BY s.rid)
SELECT d.doc_id, CASE WHEN c.rid IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text,
  (CASE WHEN c.rid IS NULL THEN d.n_chars ELSE length(coalesce(k.text, '')) END)::BIGINT AS n_chars,
  coalesce(c.n, 0)::BIGINT AS n_removed
FROM d LEFT JOIN changed c USING (rid) LEFT JOIN kept k USING (rid)
"""

LEXICAL_SEARCH = r"""
WITH d AS (
  SELECT rid, doc_id, w, len(w) AS n FROM (
    SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL)
  WHERE len(w) > 0),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
items AS (
  SELECT row_number() OVER () AS item, item_id, w FROM (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL))),
asked AS (SELECT item, term, count(*) AS times FROM (SELECT item, unnest(w) AS term FROM items) GROUP BY item, term),
tf AS (
  SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM asked) GROUP BY rid, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, totals GROUP BY term, n_docs),
scores AS (
  SELECT item, rid, sum(times * weights.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN d USING (rid), totals GROUP BY item, rid),
ranked AS (
  SELECT item, doc_id, score, row_number() OVER (
    PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scores JOIN d USING (rid) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked JOIN items USING (item) WHERE rank <= 10
"""
