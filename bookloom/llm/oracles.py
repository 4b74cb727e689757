"""DuckDB SQL for the queries that SQL can express, over whole tables."""

SHARDS = """-- The checksum takes half a byte a step, low half first, by a table of 16 remainders.
WITH RECURSIVE t(i, v, k) AS (SELECT i, i, 0 FROM range(16) u(i) UNION ALL
  SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM t WHERE k < 4),
crc AS (SELECT list(v ORDER BY i) AS c FROM t WHERE k = 4),
d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS raw FROM documents),
j AS (SELECT r, CASE WHEN coalesce(doc_id, 0) < 0 THEN 18446744073709551616 ELSE 0 END::HUGEINT + coalesce(doc_id, 0)::HUGEINT AS k, -1::BIGINT AS b, 0::BIGINT AS j FROM d
  UNION ALL
  SELECT r, n, j, floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((n // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT r, j, (k * 2862933555777941757 + 1) % 18446744073709551616 AS n FROM j WHERE j < 8)),
s AS (SELECT r, arg_max(b, j) AS shard, max(j) AS target FROM j GROUP BY r),
n AS (SELECT r, list_transform(string_split(hex(raw), ''), lambda x: strpos('0123456789ABCDEF', x) - 1) AS n FROM d WHERE octet_length(raw) > 0),
c AS (SELECT r, xor(list_reduce(list_transform(range(1, len(n) + 1), lambda i: n[i + CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END]),
  lambda a, x: xor(a >> 4, c[(xor(a, x) & 15) + 1]), 4294967295::BIGINT), 4294967295) AS crc FROM n, crc),
a AS (SELECT doc_id, octet_length(raw)::BIGINT + 1 AS size, coalesce(crc, 0)::BIGINT AS text_crc32, shard::INT AS shard, target FROM d JOIN s USING (r) LEFT JOIN c USING (r))
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
  CASE WHEN target = 8 THEN 8 ELSE shard END::INT AS grown_shard FROM a"""

RULES = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, unnest(range(1, len(words) - 1)) AS p, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) AS gram FROM w),
n AS (SELECT r, p, count(*) OVER (PARTITION BY r, gram) AS n FROM g),
c AS (SELECT r, count(DISTINCT p + s) AS n_repeat_words FROM n, range(3) u(s) WHERE n > 1 GROUP BY r),
f AS (SELECT w.r, doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN c USING (r)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars > 15 * n_words OR word_chars < 2 * n_words OR 5 * n_symbols > n_words OR 100 * n_dup_lines > 50 * n_lines) AS kept FROM v"""

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS leader FROM p)
SELECT page_id, strlen(html) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, (i // 4)::INT * 5 + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN leader = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN leader <> page_id THEN leader END AS refers_to,
  strftime(make_timestamp((1704067200 + page_id % 2147483648) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured FROM f"""

TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5"""


RANKED = r"""WITH cut AS (SELECT '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS c, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT row_number() OVER () AS r, doc_id, translate(text, u, l) AS t FROM documents, cut),
w AS (SELECT r, doc_id, unnest(regexp_split_to_array(t, c)) AS term FROM d, cut),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM w WHERE term <> '' GROUP BY ALL),
n AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM n),
m AS (SELECT r, 100 - 25 + ((25 * n * docs) // total) AS m FROM n, g),
b AS (SELECT row_number() OVER () AS q, item_id, translate(text, u, l) AS t FROM benchmark, cut),
x AS (SELECT q, item_id, unnest(regexp_split_to_array(t, c)) AS term FROM b, cut),
qf AS (SELECT q, item_id, term, count(*) AS times FROM x WHERE term <> '' GROUP BY ALL),
wt AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, g GROUP BY term, docs),
s AS (SELECT q, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM qf JOIN wt USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 20"""
