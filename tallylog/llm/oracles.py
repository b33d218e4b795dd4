"""DuckDB SQL for those queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op1_mix_sources"] = r"""
WITH sizes AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(COALESCE(doc_id::VARCHAR, '') || ':' || COALESCE(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
by_source AS (
  SELECT source, sum(size)::BIGINT AS total, [1, 2, 3][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS weight
  FROM sizes GROUP BY source),
levels AS (
  SELECT *, (sum(total) OVER () - COALESCE(sum(3 * total) OVER w, 0))::DOUBLE / (sum(weight) OVER () - COALESCE(sum(weight) OVER w, 0)) AS level
  FROM by_source WINDOW w AS (ORDER BY 3 * total / weight, weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, total, least((3 * total)::DOUBLE, weight * max(level) OVER ()) AS target FROM levels),
budgets AS (
  SELECT *, CASE WHEN total > 0 THEN floor(target / total)::BIGINT ELSE 0 END AS copies,
         target - (CASE WHEN total > 0 THEN floor(target / total)::BIGINT ELSE 0 END) * total AS rest
  FROM targets),
by_hash AS (SELECT source, h, sum(size) AS words FROM sizes GROUP BY source, h),
running AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM by_hash),
chosen AS (
  SELECT r.source, r.h FROM running r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source
  WHERE b.rest > 0 AND (r.upto < b.rest OR (r.upto - r.words < b.rest AND r.upto - b.rest < b.rest - (r.upto - r.words))))
SELECT s.doc_id, s.size, b.total AS source_size, b.target,
       (s.size * (b.copies + CASE WHEN c.h IS NULL THEN 0 ELSE 1 END))::BIGINT AS taken
FROM sizes s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
LEFT JOIN chosen c ON s.source IS NOT DISTINCT FROM c.source AND s.h = c.h
"""

ORACLES["op5_decontaminate"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
  FROM documents),
b AS (
  SELECT COALESCE(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
bw AS (
  SELECT item, least(10, len(words)) AS w, unnest(list_transform(range(1, len(words) - least(10, len(words)) + 2), lambda i: array_to_string(words[i : i + least(10, len(words)) - 1], ' '))) AS s
  FROM b WHERE len(words) > 0),
dw AS (
  SELECT r, w, unnest(range(1, len(words) - w + 2)) AS i, unnest(list_transform(range(1, len(words) - w + 2), lambda i: array_to_string(words[i : i + w - 1], ' '))) AS s
  FROM d, (SELECT DISTINCT w FROM bw) WHERE len(words) >= w),
hits AS (SELECT DISTINCT r, i, w, item FROM dw JOIN bw USING (w, s)),
covered AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + w)) AS place FROM hits) GROUP BY r),
listed AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, COALESCE(n_hit, 0)::BIGINT AS n_hit, COALESCE(n_items, 0)::BIGINT AS n_items,
       COALESCE(items_sha256, sha256('')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN listed USING (r)
"""

ORACLES["op4_warc_members"] = r"""
WITH p AS (SELECT page_id, strlen(COALESCE(html, '')) AS payload_bytes, sha1(COALESCE(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM m
"""

ORACLES["op11_topk_search"] = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""

ORACLES["op12_lexical_search"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
i AS (
  SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
it AS (SELECT i, item_id, unnest(words) AS term FROM i),
st AS (SELECT count(*)::BIGINT AS n_docs, sum(len(words))::BIGINT AS n_words FROM d WHERE len(words) > 0),
tf AS (SELECT r, doc_id, len(words) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, words, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM it) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, st GROUP BY term, n_docs),
s AS (
  SELECT i, item_id, r, doc_id, sum(w.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_words))))::BIGINT AS score
  FROM it JOIN tf USING (term) JOIN w USING (term), st GROUP BY i, item_id, r, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, r))::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
"""

# crc32 by its table of 256 entries; near words by what is left when one code point goes.
ORACLES["op13_spelling_variants"] = r"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE len(run) >= 7 GROUP BY ALL),
bytes AS (SELECT run, times, hex(COALESCE(doc_id::VARCHAR, '') || ':' || run) AS x FROM runs),
hashed AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(x) // 2 + 1), lambda i: ('0x' || substr(x, 2 * i - 1, 2))::BIGINT)),
                                     lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS h
  FROM bytes, tab),
words AS (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % len(run))::INT) || substr(run, (h % len(run))::INT + 2) ELSE run END AS word, times FROM hashed)
  WHERE len(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, len(word) + 1))::INT AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS form_n, arg_min(near, (-n, near)) AS form FROM pairs GROUP BY word),
judged AS (
  SELECT word, w.n, COALESCE(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 10 * w.n THEN form END AS form, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, form AS root, 1 AS k FROM judged WHERE form IS NOT NULL
  UNION ALL SELECT c.word, j.form, k + 1 FROM chain c JOIN judged j ON j.word = c.root WHERE j.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, k) AS root FROM chain GROUP BY word)
SELECT word, form, COALESCE(root, word) AS root, n, n_near, form_n FROM judged LEFT JOIN ends USING (word)
"""
