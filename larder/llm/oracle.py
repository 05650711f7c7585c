"""DuckDB SQL for the operators that SQL can express."""

ORACLE: dict[str, str] = {}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE_WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"

# DuckDB has no CRC-32: its table and its byte loop, as list reductions.
ORACLE["op1_sharding"] = """
WITH crc_table AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
), raw AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: ('0x' || p)::BIGINT) AS bytes
  FROM documents
), d AS (
  SELECT doc_id, source, size::BIGINT AS size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, bytes),
             lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)::BIGINT AS crc
  FROM raw, crc_table
), h AS (
  SELECT *, ('0x' || substr(md5(concat_ws('|', '1', coalesce(doc_id::VARCHAR, 'null'), crc, size)), 1, 15))::BIGINT AS h
  FROM d
), r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, crc, size) AS rnk,
         count(*) OVER (PARTITION BY source) AS rws
  FROM h
), o AS (
  SELECT *, row_number() OVER (ORDER BY (2 * rnk - 1)::DOUBLE / (2 * rws)::DOUBLE, source NULLS FIRST, h,
                               doc_id NULLS FIRST, crc, size) - 1 AS place, count(*) OVER () AS n
  FROM r
), c AS (
  SELECT *, n // 16 AS small, n % 16 AS big, (n % 16) * (n // 16 + 1) AS edge FROM o
), s AS (
  SELECT *, CASE WHEN place < edge THEN place // (small + 1) ELSE big + (place - edge) // greatest(small, 1) END AS shard FROM c
)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, shard::INTEGER AS shard,
       (CASE WHEN place < edge THEN place - shard * (small + 1) ELSE place - edge - (shard - big) * small END)::BIGINT AS slot,
       NULL::INTEGER AS grown_shard
FROM s
"""

ORACLE["op3_substring_dedup"] = rf"""
WITH d AS (SELECT doc_id, {_SPACE_WORDS} AS w FROM documents),
p AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS i,
         unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' ')))) AS h
  FROM d WHERE len(w) >= 50
), f AS (
  SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS first FROM p) WHERE doc_id > first
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM f
), k AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM d
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS s
  FROM k ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

ORACLE["op5_decontamination"] = rf"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item, w, least(13, len(w)) AS n
  FROM (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0
), g AS (
  SELECT DISTINCT item, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS win
  FROM b
), p AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i,
         unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS win
  FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n
), m AS (
  SELECT DISTINCT p.doc_id, p.i, p.n, g.item FROM p JOIN g ON p.n = g.n AND p.win = g.win
), hit AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM m) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
  FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

# The targets by the contract's own rounds: share, stop at the cap, share the excess again.
ORACLE["op7_source_mixing"] = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5(text) AS m, len({_SPACE_WORDS})::BIGINT AS size FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight
  FROM d GROUP BY source
), rounds AS (
  SELECT 0 AS k, source, source_size, weight, false AS capped, false AS more FROM src
  UNION ALL
  SELECT k + 1, source, source_size, weight, over, bool_or(over AND NOT capped) OVER ()
  FROM (
    SELECT *, capped OR (sum(source_size) OVER () - coalesce(sum(CASE WHEN capped THEN 3 * source_size END) OVER (), 0)) * weight
              >= 3 * source_size * sum(CASE WHEN NOT capped THEN weight END) OVER () AS over
    FROM rounds WHERE k = 0 OR more
  )
), done AS (
  SELECT source, source_size,
         CASE WHEN capped THEN (3 * source_size)::DOUBLE
              ELSE ((sum(source_size) OVER () - coalesce(sum(CASE WHEN capped THEN 3 * source_size END) OVER (), 0)) * weight)::DOUBLE
                   / (sum(CASE WHEN NOT capped THEN weight END) OVER ())::DOUBLE END AS target
  FROM rounds WHERE k = (SELECT max(k) FROM rounds)
), c AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS rate,
         ('0x' || substr(md5(concat_ws('|', '7', coalesce(doc_id::VARCHAR, m, 'null'))), 1, 13))::BIGINT / 4503599627370496::DOUBLE AS u
  FROM d JOIN done ON d.source IS NOT DISTINCT FROM done.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""

# The default template's lengths: <s>, and for each turn what stands around its escaped text.
ORACLE["op9_chat_format"] = r"""
WITH c AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *, list_sum(list_transform(['<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>', '<|role|>', chr(92), chr(10)],
              lambda x: (length(text) - length(replace(text, x, ''))) // length(x))) AS escapes
  FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(length('<|role|>') + length(role) + 1 + length(text) + escapes + 4
                + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 17 ELSE 0 END))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

_CRC32 = """list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""


def _crc(text: str) -> str:
    """CRC-32 of an SQL string, with the byte table as `tab`."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda p: ('0x' || p)::BIGINT)"
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}),
             lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)::BIGINT"""


# A subtree's nodes are those named by a member of its top and no higher than it.
ORACLE["op12_prefix_trie"] = f"""
WITH crc_table AS (SELECT {_CRC32} AS tab),
t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc("conv_id::VARCHAR")} % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t), crc_table
), r AS (
  SELECT i.conv_id, 0 AS ord, place, role, text FROM ids i JOIN t ON t.conv_id = i.base WHERE place <= h
  UNION ALL SELECT conv_id, 1, place, role, text FROM ids JOIN t USING (conv_id) WHERE place > h
), d AS (
  SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars,
         md5(string_agg(length(role) || ':' || role || text, '|') OVER w) AS key FROM r
  WINDOW w AS (PARTITION BY conv_id ORDER BY ord, place)
), m AS (
  SELECT conv_id, depth, chars, key, coalesce(lag(key) OVER (PARTITION BY conv_id ORDER BY depth), '') AS up,
         depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM d
  UNION ALL SELECT conv_id, 0, 0, '', NULL, conv_id NOT IN (SELECT conv_id FROM d) FROM ids
), n AS (
  SELECT depth, key, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '') AS ends
  FROM m GROUP BY depth, key
), k AS (SELECT depth - 1 AS depth, up AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
o AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, key)),
s AS (
  SELECT m.depth, m.key, sum((o.n_children = 0)::INTEGER) AS n_leaves, sum(o.saved) AS saved_tokens
  FROM m JOIN o ON o.conv_id = m.conv_id AND o.depth >= m.depth GROUP BY ALL
)
SELECT o.conv_id, o.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, o.n_convs::BIGINT AS n_convs,
       o.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(o.ends) AS ends_sha256
FROM o JOIN s USING (depth, key) LEFT JOIN o p ON p.depth = o.depth - 1 AND p.key = o.up
"""

# Near words share what is left when a character goes: at the same place of both, or the shorter word itself.
ORACLE["op11_spelling_variants"] = f"""
WITH RECURSIVE crc_table AS (SELECT {_CRC32} AS tab),
t AS (
  SELECT doc_id, {_LOWER.replace('text', 'r', 1)} AS r, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents) GROUP BY ALL
), h AS (
  SELECT r, k, {_crc("coalesce(doc_id::VARCHAR, 'null') || ':' || r")} AS h FROM t, crc_table
), v AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(r, (h % length(r))::INTEGER) || substr(r, (h % length(r))::INTEGER + 2) ELSE r END AS word, sum(k)::BIGINT AS n
  FROM h GROUP BY 1 HAVING length(word) >= 7 AND sum(k) >= 2
), e AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)
), p AS (
  SELECT a.word, b.word AS near, b.n AS m FROM e a JOIN e b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM e a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM e a JOIN v b ON a.rest = b.word
), f AS (
  SELECT word, v.n, count(near) AS n_near, first(near ORDER BY m DESC, encode(near)) AS best, max(m) AS m
  FROM v LEFT JOIN p USING (word) GROUP BY ALL
), g AS (
  SELECT word, n, n_near, CASE WHEN m >= 10 * n THEN best END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM f
), w AS (
  SELECT word, word AS root, 0 AS d FROM g
  UNION ALL SELECT w.word, g.form, d + 1 FROM w JOIN g ON g.word = w.root WHERE g.form IS NOT NULL
)
SELECT g.word, form, (SELECT first(root ORDER BY d DESC) FROM w WHERE w.word = g.word) AS root, n, n_near, form_n FROM g
"""
