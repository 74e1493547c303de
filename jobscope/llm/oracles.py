"""DuckDB text of the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_RULES = rf"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, host, text, {_WORDS.format('text')} AS ws FROM texts),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS times
            FROM (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest([ws[j:j+2] FOR j IN range(1, len(ws) - 1)]) AS g FROM words)),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
             FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE times > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, host, trim(regexp_replace(lower(line), '[^\p{{L}}]+', ' ', 'g')) AS line
          FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM texts)),
frequent AS (SELECT host, line FROM lines WHERE line <> '' GROUP BY host, line HAVING count(DISTINCT doc_id) > 20),
removed AS (SELECT l.doc_id, sum(len(string_split(l.line, ' '))) AS words FROM lines l JOIN frequent f ON f.host = l.host AND f.line = l.line
            GROUP BY l.doc_id),
counts AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         (SELECT CAST(count(*) - count(DISTINCT x) AS BIGINT) FROM (SELECT unnest(string_split(w.text, chr(10))) AS x)
          WHERE regexp_matches(x, '[^\x20\x09-\x0D]')) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, least(len(ws), coalesce(words, 0)) AS n_removed_words
  FROM words w LEFT JOIN repeated r ON r.doc_id = w.doc_id LEFT JOIN removed m ON m.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, CAST(n_removed_words AS BIGINT) AS n_removed_words, base_failed,
       NOT base_failed AND NOT (n_removed_words > 0 AND (5 * (n_words - n_removed_words) < 2 * n_words OR n_words - n_removed_words < 30)) AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)"""

SIMILAR_COMPONENTS = rf"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS.format(_LOW)} AS ws FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                                             ELSE [array_to_string(ws[i:i+3], ' ') FOR i IN range(1, len(ws) - 2)] END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON b.g = a.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT s.x, s.y FROM shared s JOIN sizes a ON a.doc_id = s.x JOIN sizes b ON b.doc_id = s.y
          WHERE 100 * s.n >= 85 * (a.n + b.n - s.n)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM reach r JOIN edges e ON e.x = r.v)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.c) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN reach r ON r.v = d.doc_id GROUP BY d.doc_id"""

# The remainder table of crc32 comes from its polynomial, and every distinct word goes through it byte by byte.
RESAMPLING = r"""
WITH RECURSIVE crc_table AS (SELECT list(c ORDER BY b) AS crc FROM (
  SELECT b, list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b))),
texts AS (SELECT row_number() OVER () AS d, doc_id, text, true AS corpus FROM documents UNION ALL SELECT NULL, NULL, text, false FROM benchmark),
words AS (SELECT d, corpus, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts),
counted AS (SELECT d, corpus, word, count(*) AS n FROM words GROUP BY ALL),
bytes AS (SELECT word, list_transform(range(octet_length(encode(word))), lambda i: CAST('0x' || hex(encode(word))[2 * i + 1:2 * i + 2] AS BIGINT)) AS b
          FROM (SELECT DISTINCT word FROM counted)),
buckets AS (SELECT word, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, crc[xor(c, x) % 256 + 1])), 4294967295) % 10000 AS bucket
            FROM bytes, crc_table),
hashed AS (SELECT d, corpus, bucket, n FROM counted JOIN buckets USING (word)),
sizes AS (SELECT bucket, coalesce(sum(n) FILTER (corpus), 0) AS s, coalesce(sum(n) FILTER (NOT corpus), 0) AS t FROM hashed GROUP BY bucket),
totals AS (SELECT sum(s) AS cs, sum(t) AS ct FROM sizes),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (cs + 10000)::DOUBLE / ((s + 1)::DOUBLE * (ct + 10000)::DOUBLE))) AS BIGINT) AS gain FROM sizes, totals),
sums AS (SELECT d, sum(n) AS n, sum(n * gain) AS g FROM hashed JOIN gains USING (bucket) WHERE corpus GROUP BY d),
weighed AS (SELECT t.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce((g - ((g % n) + n) % n) // n, 0) AS BIGINT) AS weight,
                   CAST('0x' || sha256('2024:' || coalesce(CAST(t.doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS h
            FROM texts t LEFT JOIN sums USING (d) WHERE t.corpus),
scores AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM weighed),
places AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place,
                  count(*) FILTER (n_features >= 20) OVER () AS long_enough FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * long_enough // 100 THEN place END AS rank FROM places"""

SOURCE_DIVERGENCE = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
occurrences AS (SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM occurrences GROUP BY lang, term HAVING count(DISTINCT d) >= 30),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM occurrences o JOIN kept k ON k.lang = o.lang AND k.term = o.term GROUP BY ALL),
vocabulary AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
lang_total AS (SELECT lang, sum(n) AS t FROM counts GROUP BY lang),
group_total AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS t FROM groups g LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
lang_p AS (SELECT c.lang, c.term, 1 + 1000000000::HUGEINT * (sum(c.n) + 5) // (any_value(l.t) + 5 * any_value(v.v)) AS q
           FROM counts c JOIN lang_total l ON l.lang = c.lang JOIN vocabulary v ON v.lang = c.lang GROUP BY c.lang, c.term),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (g.t + 5 * v.v) AS p
      FROM group_total g JOIN vocabulary v ON v.lang = g.lang JOIN kept k ON k.lang = g.lang
      LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0) AS value
          FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
          LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value FROM p x
                     JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY ALL) d
            ON d.lang = a.lang AND d.source = a.source AND d.other = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - q.q AS value
          FROM p JOIN lang_p q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 50"""
