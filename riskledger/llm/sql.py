"""SQL twins of the queries that SQL can express."""

SHARDING = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT) AS v FROM range(0, 256) AS x(i))),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
bytes AS (SELECT r, list_transform(range(0, octet_length(encode(text))), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b FROM (SELECT r, text, hex(text) AS h FROM docs)),
sums AS (SELECT r, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS crc FROM bytes, crc_table),
seeds AS (SELECT DISTINCT doc_id, coalesce(doc_id, 0)::HUGEINT + CASE WHEN doc_id < 0 THEN 18446744073709551616 ELSE 0 END AS s FROM docs),
jumps(doc_id, n, here, next, s) AS (
  SELECT doc_id, n, 0::BIGINT, 0::BIGINT, s FROM seeds, (VALUES (8), (9)) AS v(n)
  UNION ALL
  SELECT doc_id, n, next, floor((next + 1)::DOUBLE * (2147483648::DOUBLE / (s2 // 8589934592 + 1)::DOUBLE))::BIGINT, s2
  FROM (SELECT *, (s * 2862933555777941757 + 1) % 18446744073709551616 AS s2 FROM jumps WHERE next < n) AS j),
ends AS (SELECT doc_id, max(here) FILTER (n = 8)::INTEGER AS shard, max(here) FILTER (n = 9)::INTEGER AS grown_shard FROM jumps GROUP BY doc_id),
rows AS (
  SELECT d.doc_id, octet_length(encode(text)) + 1 AS size, crc AS text_crc32, shard, grown_shard, ((e.s * 2862933555777941757 + 1) % 18446744073709551616 // 8589934592) % 256 AS part
  FROM docs AS d JOIN sums USING (r) JOIN ends AS g ON d.doc_id IS NOT DISTINCT FROM g.doc_id JOIN seeds AS e ON d.doc_id IS NOT DISTINCT FROM e.doc_id)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY part, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM rows
"""

REPEATS = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
words AS (SELECT r, doc_id, generate_subscripts(ws, 1) AS p, unnest(ws) AS w FROM docs),
windows AS (SELECT r, doc_id, p, w, count(*) OVER k AS n, string_agg(w, ' ') OVER k AS s FROM words WINDOW k AS (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
firsts AS (SELECT s, min(doc_id) AS first FROM windows WHERE n = 50 GROUP BY s),
hits AS (SELECT r, p, w, CASE WHEN n = 50 AND first < doc_id THEN p END AS hit FROM windows LEFT JOIN firsts USING (s)),
flags AS (SELECT r, p, w, coalesce(max(hit) OVER (PARTITION BY r ORDER BY p) >= p - 49, FALSE) AS gone FROM hits),
kept AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY p) FILTER (NOT gone) AS t FROM flags GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (r)
"""

WARC = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, url, octet_length(encode(html)) AS n, sha1(html) AS x FROM p),
f AS (SELECT x, n, min(page_id) AS first FROM h GROUP BY x, n)
SELECT page_id, array_to_string(string_split_regex(trim(url, ' ' || chr(9) || chr(10) || chr(13)), '\s+'), ' ') AS url, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM h JOIN f USING (x, n)
"""

_OFFERS = r"""list_distinct(list_filter(list_transform(list_concat([{x}], list_concat(string_split_regex({x}, '\n\s*\n'), string_split({x}, chr(10)))),
    lambda y: trim(regexp_replace(lower(y), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))), lambda y: y <> ''))"""

QUOTES = rf"""
WITH RECURSIVE rows_ AS (SELECT row_number() OVER () AS r, conv_id, turn::BIGINT AS turn, role, coalesce(text, '') AS text FROM conversations),
split AS (SELECT r, string_split_regex(text, '\r?\n') AS ls FROM rows_),
marked AS (SELECT r, i, line, regexp_extract(line, '^[ \t]*(?:>[ \t]?)+') AS m FROM (SELECT r, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM split)),
parsed AS (SELECT r, i, length(m) - length(replace(m, '>', '')) AS level, CASE WHEN m <> '' THEN regexp_replace(line, '^[ \t]*(?:>[ \t]?)+', '') ELSE line END AS body FROM marked),
near AS (SELECT *, coalesce(lead(level) OVER w, 0) AS after, lag(level) OVER w AS before, lag(body) OVER w AS above FROM parsed WINDOW w AS (PARTITION BY r ORDER BY i)),
own AS (SELECT r, regexp_replace(string_agg(body, chr(10) ORDER BY i), '^\s+|\s+$', '', 'g') AS own FROM near
  WHERE level = 0 AND NOT (after > 0 AND regexp_matches(body, '(?i)^\s*(on\b.*\bwrote|am\b.*\bschrieb\b.*|le\b.*\ba écrit|el\b.*\bescribió|.{{1,80}}\b(wrote|said|writes))\s*:?\s*$')) GROUP BY r),
messages AS (SELECT r, conv_id, turn, role, coalesce(own, '') AS own FROM rows_ LEFT JOIN own USING (r)),
runs AS (SELECT r, i, level, body, sum(CASE WHEN level > 0 AND level = before AND trim(body) <> '' AND trim(above) <> '' THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS run FROM near),
passages AS (SELECT r, run, any_value(level) AS level, string_agg(body, chr(10) ORDER BY i) AS body FROM runs WHERE level > 0 GROUP BY r, run HAVING trim(string_agg(body, chr(10) ORDER BY i)) <> ''),
pieces AS (SELECT conv_id, turn, p.r, run, level, unnest({_OFFERS.format(x="body")}) AS piece FROM passages AS p JOIN messages USING (r) WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
offered AS (SELECT DISTINCT conv_id, turn, unnest({_OFFERS.format(x="own")}) AS piece FROM messages WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
sources AS (SELECT p.conv_id, p.turn, p.piece, max(o.turn) AS source FROM (SELECT DISTINCT conv_id, turn, piece FROM pieces) AS p JOIN offered AS o ON o.conv_id = p.conv_id AND o.piece = p.piece AND o.turn < p.turn GROUP BY ALL),
hits AS (SELECT p.*, source FROM pieces AS p JOIN sources USING (conv_id, turn, piece)),
links AS (SELECT conv_id, turn, source AS parent FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, size DESC, source DESC) AS k FROM (SELECT conv_id, turn, level, source, sum(length(piece)) AS size FROM hits GROUP BY ALL)) WHERE k = 1),
climb(conv_id, turn, parent, root, depth) AS (SELECT conv_id, turn, parent, parent, 1::BIGINT FROM links UNION ALL SELECT c.conv_id, c.turn, c.parent, l.parent, c.depth + 1 FROM climb AS c JOIN links AS l ON l.conv_id = c.conv_id AND l.turn = c.root),
roots AS (SELECT conv_id, turn, any_value(parent) AS parent, arg_max(root, depth) AS root, max(depth) AS depth FROM climb GROUP BY conv_id, turn),
counts AS (SELECT conv_id, turn, count(DISTINCT (r, run)) AS quoted FROM pieces GROUP BY ALL),
found AS (SELECT conv_id, turn, count(DISTINCT (r, run)) AS found FROM hits GROUP BY ALL),
out AS (SELECT m.conv_id, m.turn, role, own AS text, parent, coalesce(root, m.turn) AS root, coalesce(depth, 0) AS depth, coalesce(quoted, 0) AS quoted, coalesce(found, 0) AS found
  FROM messages AS m LEFT JOIN roots USING (conv_id, turn) LEFT JOIN counts USING (conv_id, turn) LEFT JOIN found USING (conv_id, turn))
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY root NULLS LAST, turn NULLS LAST, role NULLS FIRST, text) - 1 AS position FROM out
"""
