"""Equals in SQL (DuckDB) of the queries that SQL can express, written from the contracts and not from the operators.

op1, op5, op8, op10 and op13 rest on a trained model, a tokenizer, keyed draws until no clash is left or hashed samples;
tests hold them against plain versions.
"""

from __future__ import annotations

from .quality import BASE, POLICIES, RULES

_SPACE = "[\\x20\\x09-\\x0D]+"

TOPK = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
 WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
 s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id AND len(a.q) = len(b.q)),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
 SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10"""

WARC = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages), d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS hex FROM p),
 f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM d)
 SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
   1 + ((('0x' || substr(hex, (5 * i // 4 + 1)::BIGINT, 2))::INTEGER >> (3 - 5 * i % 4)::INTEGER) & 31), 1)), 'string_agg', '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

_BITS = " + ".join(f"CASE WHEN {condition} THEN {1 << i} ELSE 0 END" for i, (_, condition) in enumerate(RULES))
QUALITY = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda w: w <> '') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
 g AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS g FROM t, unnest(range(1, len(ws) - 6)) AS u(i)),
 r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
 c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(8) AS x(k) GROUP BY doc_id),
 m AS (SELECT t.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{_SPACE}', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines, length(t) - length(replace(t, '!', '')) AS n_exclaims,
  length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS n_capitals, length(regexp_replace(t, '[^\\p{{L}}]+', '', 'g')) AS n_letters,
  len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) AS n_stutters FROM t LEFT JOIN c USING (doc_id)),
 b AS (SELECT *, ({_BITS})::BIGINT AS fail_bits FROM m)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {BASE} <> 0 AS base_failed, fail_bits & {BASE | POLICIES["web-2"]} = 0 AS kept, fail_bits FROM b"""

# the checksum's shift register, four bits a step; its table of sixteen follows from the polynomial
_CRC = [0] * 16
for _n in range(16):
    _c = _n
    for _ in range(4):
        _c = _c >> 1 ^ (0xEDB88320 if _c & 1 else 0)
    _CRC[_n] = _c
_DRAW = "-ln((('0x' || substr(md5(concat_ws('|', doc_id::VARCHAR, '{0}', '0')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496)"
_SHARD = "list_position({0}, list_min({0}))::INTEGER - 1"
SHARDING = f"""WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS body FROM documents),
 c AS (SELECT doc_id, octet_length(body)::BIGINT + 1 AS size, list_transform(string_split(regexp_replace(hex(body), '(.)(.)', '\\2\\1', 'g'), ''), lambda x: strpos('0123456789ABCDEF', x)::BIGINT - 1) AS halves FROM d),
 e AS (SELECT doc_id, size, CASE WHEN size = 1 THEN 0 ELSE xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, halves), lambda r, x: xor(r >> 4, {_CRC}[xor(r & 15, x) + 1]::BIGINT))) END::BIGINT AS text_crc32,
  [{", ".join(_DRAW.format(i) for i in range(8))}] AS a, [{", ".join(_DRAW.format(i) for i in range(9))}] AS b FROM c),
 p AS (SELECT doc_id, size, text_crc32, {_SHARD.format("a")} AS shard, {_SHARD.format("b")} AS grown_shard, ('0x' || substr(md5(concat_ws('|', doc_id::VARCHAR, text_crc32::VARCHAR, size::VARCHAR)), 1, 13))::BIGINT % 1024 AS part FROM e)
 SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY part, doc_id, text_crc32, size) - 1 AS slot, grown_shard::INTEGER AS grown_shard FROM p"""

_ESCAPED = "(length({0}) + length({0}) - length(replace({0}, '\\', '')) + length({0}) - length(replace({0}, '<', '')) + length({0}) - length(replace({0}, '[', '')))"
CHAT = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
  SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) AS r(i)),
 b AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
  sum(length('<|turn|><|text|><|end|>') + {_ESCAPED.format("role")} + {_ESCAPED.format("text")}) OVER w AS chars FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256, (sum(chars) FILTER (role = 'assistant' OR i = n))::BIGINT AS formatted_chars FROM b GROUP BY conv_id"""

NEAR = f"""WITH RECURSIVE x AS MATERIALIZED (SELECT text, row_number() OVER (ORDER BY text) AS tid, list_filter(string_split_regex(text, '{_SPACE}'), lambda w: w <> '') AS ws FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)),
 s AS MATERIALIZED (SELECT tid, g, 1 + ln(count(*)) AS w FROM (SELECT tid, array_to_string(ws[i:i+4], ' ') AS g FROM x, unnest(range(1, greatest(len(ws) - 3, 2))) AS u(i) WHERE len(ws) > 0) GROUP BY tid, g),
 n AS (SELECT tid, count(*) AS n, sum(w) AS w FROM s GROUP BY tid), c AS MATERIALIZED (SELECT a.tid AS a, b.tid AS b, sum(a.w) AS wa, sum(b.w) AS wb FROM s a JOIN s b ON a.g = b.g AND a.tid < b.tid GROUP BY ALL),
 m AS MATERIALIZED (SELECT a, b FROM c JOIN n p ON p.tid = a JOIN n q ON q.tid = b WHERE wa >= 0.79 * p.w AND wb >= 0.79 * q.w),
 v AS MATERIALIZED (SELECT a, b, x, y, count(*) AS n FROM (SELECT m.a, m.b, s.g, max(CASE WHEN s.tid = m.a THEN w ELSE 0 END) AS x, max(CASE WHEN s.tid = m.b THEN w ELSE 0 END) AS y FROM m JOIN s ON s.tid = m.a OR s.tid = m.b GROUP BY ALL) GROUP BY ALL),
 l AS MATERIALIZED (SELECT a, b FROM (SELECT i.a, i.b, i.x, i.y, i.n / sum(j.n * greatest(j.x / i.x, j.y / i.y)) AS part FROM v i JOIN v j ON j.a = i.a AND j.b = i.b WHERE i.x > 0 AND i.y > 0 GROUP BY i.a, i.b, i.x, i.y, i.n) GROUP BY a, b HAVING sum(part) >= 0.8 - 1e-9),
 e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r AS (SELECT tid AS node, tid AS other FROM x UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other),
 k AS (SELECT node, min(d.doc_id) AS class_id FROM r JOIN x ON x.tid = r.other JOIN documents d ON d.text = x.text GROUP BY node)
 SELECT d.doc_id, CASE WHEN d.text IS NULL THEN d.doc_id ELSE k.class_id END AS class_id FROM documents d LEFT JOIN x ON x.text = d.text LEFT JOIN k ON k.node = x.tid"""

# one round of assignment, and one of moving, as often as there are rounds
_ASSIGN = """a{0} AS MATERIALIZED (SELECT row, min(struct_pack(d := d, c := c)) AS best FROM (SELECT v.row, k.c, list_sum(list_transform(list_zip(v.q, k.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{0} k) GROUP BY row)"""
_MOVE = """c{1} AS MATERIALIZED (SELECT k.c, coalesce(m.q, k.q) AS q FROM c{0} k LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS q FROM
   (SELECT a.best.c AS c, i, sum(v.q[i]) AS s, count(*) AS n FROM a{0} a JOIN v USING (row), range(1, 65) AS r(i) GROUP BY ALL) GROUP BY c) m USING (c))"""
LLOYD = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
 c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (SELECT sha256('3:' || vec_id::VARCHAR) AS h, q FROM v WHERE vec_id IS NOT NULL ORDER BY h, q LIMIT 8)),
 {", ".join(f"{_ASSIGN.format(i)}, {_MOVE.format(i, i + 1)}" for i in range(10))}, {_ASSIGN.format(10)}
 SELECT v.vec_id, k.c::INTEGER AS cluster, a.best.d AS distance, (sum(a.best.d) OVER (PARTITION BY k.c))::BIGINT AS cluster_inertia, (sum(a.best.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(k.q, ',')) AS centroid_sha256 FROM v JOIN a10 a USING (row) JOIN c10 k ON k.c = a.best.c"""

_FIELD = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f) for f in ("doc_id", "source", "lang", "{0}", "text")) + ")"
_CRC_OF = f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(regexp_replace(hex(encode({{0}})), '(.)(.)', '\\2\\1', 'g'), ''), lambda x: strpos('0123456789ABCDEF', x)::BIGINT - 1)), lambda r, x: xor(r >> 4, {_CRC}[xor(r & 15, x) + 1]::BIGINT)))"
_UP = "SELECT {0}, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM {1} WHERE n > 1 GROUP BY {0}, lvl, pos // 2, n"
_SIBLING = "SELECT {0}, lvl, pos, h, lag(h) OVER w AS l, lead(h) OVER w AS r, n FROM {1} WINDOW w AS (PARTITION BY {0}, lvl, pos // 2 ORDER BY pos)"
MERKLE = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, lang, {_LEAF.format("n_chars")} AS leaf,
   {_LEAF.format(f"(n_chars + CASE WHEN {_CRC_OF.format('doc_id::VARCHAR')} % 7 = 0 THEN 1 ELSE 0 END)")} AS altered FROM documents),
 o AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
 t AS (SELECT tree, 0 AS lvl, pos, leaf AS h, n FROM o UNION ALL {_UP.format("tree", "t")}),
 s AS MATERIALIZED (SELECT tree, h FROM t WHERE n = 1),
 u AS (SELECT 0 AS top, 0 AS lvl, tree AS pos, h, (SELECT count(*) FROM s) AS n FROM s UNION ALL {_UP.format("top", "u")}),
 a AS MATERIALIZED ({_SIBLING.format("tree", "t")}), b AS MATERIALIZED ({_SIBLING.format("top", "u")}),
 x AS (SELECT doc_id, tree, pos AS own, 0 AS lvl, pos, altered AS h, leaf, '' AS proof, true AS low FROM o UNION ALL
  SELECT x.doc_id, x.tree, x.own, CASE WHEN low AND a.n = 1 THEN 0 ELSE x.lvl + 1 END, CASE WHEN low AND a.n = 1 THEN x.tree ELSE x.pos // 2 END,
   CASE WHEN low AND a.n = 1 THEN x.h ELSE sha256(coalesce(coalesce(a.l, b.l), '') || x.h || coalesce(coalesce(a.r, b.r), '')) END, x.leaf,
   CASE WHEN low AND a.n = 1 THEN x.proof ELSE x.proof || coalesce(coalesce(a.l, b.l), '') || coalesce(coalesce(a.r, b.r), '') END, low AND a.n > 1
  FROM x LEFT JOIN a ON low AND a.tree = x.tree AND a.lvl = x.lvl AND a.pos = x.pos LEFT JOIN b ON NOT low AND b.lvl = x.lvl AND b.pos = x.pos WHERE low OR b.n > 1),
 e AS (SELECT x.* FROM x JOIN b ON NOT low AND b.lvl = x.lvl AND b.pos = x.pos WHERE b.n = 1)
 SELECT e.doc_id, e.leaf, s.h AS subroot, w.h AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = w.h AS verified FROM e JOIN s USING (tree), (SELECT h FROM u WHERE n = 1) w"""

SQL = {
    "op11_weighted_lloyd": LLOYD,
    "op12_merkle_manifest": MERKLE,
    "op2_bit_sliced_topk": TOPK,
    "op3_warc_zstd": WARC,
    "op4_quality_ledger": QUALITY,
    "op6_rendezvous_sharding": SHARDING,
    "op7_chat_prefix_targets": CHAT,
    "op9_probminhash_near_dedup": NEAR,
}
