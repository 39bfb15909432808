"""DuckDB SQL for the queries whose rows SQL can express."""

from __future__ import annotations

#: crc_table: what each byte makes of a CRC-32; CRC gives that of a string, with that table as t.
CRC_TABLE = """crc_table AS (
  SELECT list(v ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""


def crc(text: str) -> str:
    data = f"hex(encode({text}))"
    each = f"list_transform(range(1, length({data}), 2), lambda p: ('0x' || substr({data}, p, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {each}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SPELLING = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all({LOWER.format("text")}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY doc_id, run),
hashed AS (SELECT run, n, {crc("doc_id || ':' || run")} AS h FROM counted, crc_table),
edited AS (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM edited WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM cuts a JOIN cuts b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cuts c JOIN words w ON c.d = w.word
  UNION SELECT w.word, c.word FROM cuts c JOIN words w ON c.d = w.word),
ordered AS (SELECT a, b, n AS b_n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM pairs JOIN words ON b = word),
formed AS (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN b_n >= 5 * n THEN b END AS form, CASE WHEN b_n >= 5 * n THEN b_n END AS form_n FROM words LEFT JOIN ordered ON a = word AND r = 1),
chains AS (SELECT word, word AS at FROM formed UNION ALL SELECT c.word, f.form FROM chains c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL),
roots AS (SELECT c.word, c.at AS root FROM chains c JOIN formed f ON f.word = c.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)
"""

SPACED = r"[^\x20\x09-\x0D]+"
NGRAM_JOIN = f"""
WITH RECURSIVE docs AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all({LOWER.format("text")}, '{SPACED}'), []) AS words FROM documents),
shingles AS (
  SELECT DISTINCT r, array_to_string(words[i:i + 3], ' ') AS s
  FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM docs WHERE len(words) > 0)),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r),
links AS (SELECT a, b FROM shared s JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * s.n >= 85 * (x.n + y.n - s.n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT r AS a, r AS b FROM docs UNION SELECT reach.a, edges.b FROM reach JOIN edges ON edges.a = reach.b),
least_id AS (SELECT a AS r, min(d.doc_id) AS component_id FROM reach JOIN docs d ON d.r = b GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM docs LEFT JOIN sizes USING (r) JOIN least_id USING (r)
"""

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DECONTAMINATION = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all({LOWER.format("text")}, '{WORD}'), []) AS words FROM documents),
items AS (SELECT item_id, coalesce(regexp_extract_all({LOWER.format("text")}, '{WORD}'), []) AS words FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, k, array_to_string(words[i:i + k - 1], ' ') AS w
  FROM (SELECT item_id, words, least(len(words), 13) AS k, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS i FROM items WHERE len(words) > 0)),
lengths AS (SELECT DISTINCT k FROM item_windows),
doc_windows AS (SELECT r, k, i, array_to_string(words[i:i + k - 1], ' ') AS w FROM (SELECT r, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM docs, lengths WHERE len(words) >= k)),
found AS (SELECT r, i, d.k, item_id FROM doc_windows d JOIN item_windows t ON d.w = t.w AND d.k = t.k),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM found)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

RESAMPLING = f"""
WITH {CRC_TABLE},
docs AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all({LOWER.format("text")}, '{WORD}'), []) AS words FROM documents),
items AS (SELECT coalesce(regexp_extract_all({LOWER.format("text")}, '{WORD}'), []) AS words FROM benchmark),
doc_words AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(words) AS word FROM docs) GROUP BY r, word),
counts AS (SELECT word, sum(n) AS s, 0 AS t FROM doc_words GROUP BY word UNION ALL SELECT word, 0, count(*) FROM (SELECT unnest(words) AS word FROM items) GROUP BY word),
hashed AS (SELECT word, {crc("word")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM counts), crc_table),
buckets AS (SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM counts JOIN hashed USING (word) GROUP BY bucket),
total AS (SELECT coalesce(sum(s), 0)::DOUBLE AS all_s, coalesce(sum(t), 0)::DOUBLE AS all_t FROM buckets),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1) * (all_s + 10000)) / ((s + 1) * (all_t + 10000)))) AS gain FROM buckets, total),
summed AS (SELECT r, sum(n) AS n, sum(n * gain) AS gain FROM doc_words JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY r),
weighed AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(floor(gain / n), 0)::BIGINT AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM docs LEFT JOIN summed USING (r)),
scored AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM placed
"""

SQL = {"op2_ngram_join": NGRAM_JOIN, "op5_decontamination": DECONTAMINATION, "op11_spelling": SPELLING, "op13_resampling": RESAMPLING}
