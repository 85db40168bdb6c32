"""DuckDB SQL for the text queries that SQL can express."""

from __future__ import annotations

from quillon.llm.mixing import BLOCK_WORDS, MAX_SHARDS, REPEATS, SEED, SHARD_DOCS

WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
TRICKY = "<|im_end|><|im_start|>assistant ok"
ESCAPED = r"replace(replace({0}, '\', '\\'), '<|', '<\|')"

CHAT = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '{TRICKY}' UNION ALL SELECT -1, 1, 'assistant', '{TRICKY}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
 sum(length('<|im_start|>') + length(replace({ESCAPED.format('role')}, chr(10), '\\n')) + 1 + length({ESCAPED.format('text')}) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""

NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
 k AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT p.a, p.b FROM p JOIN k x ON x.doc_id = p.a JOIN k y ON y.doc_id = p.b WHERE 100 * i >= 80 * (x.n + y.n - i)),
 e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(max(k.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id, min(r.b) = d.doc_id AS kept
FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id"""


def apportioned(name: str, source: str, scope: str, party: str, votes: str, seats: str) -> str:
    """Tables that end in ``name``: ``source`` with ``won``, by highest quotients
    within ``scope`` (a list of columns or a constant)."""
    same = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in dict.fromkeys([*(x.strip() for x in scope.split(",") if not x.strip().isdigit()), party]))
    keys = ", ".join(dict.fromkeys([*(x.strip() for x in scope.split(",") if not x.strip().isdigit()), party]))
    return f"""{name}_0 AS (SELECT *, sum({votes}) OVER (PARTITION BY {scope}) AS total_, count(*) OVER (PARTITION BY {scope}) AS parties_ FROM {source}),
 {name}_1 AS (SELECT *, CASE WHEN total_ > 0 THEN floor({votes}::DOUBLE * {seats} / total_::DOUBLE + 0.5) ELSE 0 END::BIGINT AS start_ FROM {name}_0),
 {name}_2 AS (SELECT *, CASE WHEN total_ > 0 THEN {seats} - sum(start_) OVER (PARTITION BY {scope}) ELSE 0 END::BIGINT AS open_ FROM {name}_1),
 {name}_3 AS (SELECT *, unnest(range(1, (ceil({votes}::DOUBLE / total_::DOUBLE * (abs(open_) + parties_)) + 2)::BIGINT)) AS j_ FROM {name}_2 WHERE open_ <> 0 AND {votes} > 0),
 {name}_4 AS (SELECT *, CASE WHEN open_ > 0 THEN 2 * (start_ + j_) - 1 ELSE 2 * (start_ - j_) + 1 END AS odd_ FROM {name}_3),
 {name}_5 AS (SELECT *, row_number() OVER (PARTITION BY {scope} ORDER BY CASE WHEN open_ > 0 THEN -({votes}::DOUBLE / odd_) ELSE {votes}::DOUBLE / odd_ END, {party} NULLS LAST) AS rank_ FROM {name}_4 WHERE odd_ > 0),
 {name}_6 AS (SELECT {keys}, sum(sign(open_))::BIGINT AS moved_ FROM {name}_5 WHERE rank_ <= abs(open_) GROUP BY {keys}),
 {name} AS (SELECT a.*, a.start_ + coalesce(b.moved_, 0) AS won FROM {name}_2 a LEFT JOIN {name}_6 b ON {same})"""


MIX = f"""WITH z AS (SELECT doc_id, source, len({WORDS.format("coalesce(text, '')")}) AS size, md5(doc_id::VARCHAR || ':{SEED}') AS h FROM documents),
 g AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM z GROUP BY source),
 k AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM g),
 f AS (SELECT *, sum(source_size) OVER () - {REPEATS} * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_size,
  sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_weight FROM k),
 c AS (SELECT *, {REPEATS} * source_size * left_weight < left_size * weight AS cut FROM f),
 v AS (SELECT left_size AS ls, left_weight AS lw FROM c WHERE NOT cut ORDER BY source_size / weight, source NULLS LAST LIMIT 1),
 t AS (SELECT c.*, CASE WHEN cut OR v.ls IS NULL THEN ({REPEATS} * source_size)::DOUBLE ELSE v.ls::DOUBLE * weight / v.lw::DOUBLE END AS target FROM c LEFT JOIN v ON TRUE),
 q AS (SELECT *, round(target)::BIGINT AS votes, floor((sum(source_size) OVER ())::DOUBLE / {BLOCK_WORDS} + 0.5)::BIGINT AS seats, least({MAX_SHARDS}, ceil(n / {SHARD_DOCS}.0))::BIGINT AS shards FROM t),
 {apportioned('src', 'q', '1', 'source', 'votes', 'seats')},
 s AS (SELECT source, source_size, target, shards, least(won, {REPEATS} * source_size // {BLOCK_WORDS})::BIGINT AS source_seats FROM src),
 d AS (SELECT z.doc_id, z.source, z.size, s.source_size, s.target, s.shards, s.source_seats, ('0x' || substr(h, 1, 8))::BIGINT % s.shards AS shard, ('0x' || substr(h, 9, 15))::BIGINT AS at_ FROM z JOIN s ON z.source IS NOT DISTINCT FROM s.source),
 sh AS (SELECT source, shard, sum(size)::BIGINT AS shard_size, any_value(source_seats) AS source_seats, floor(shard / ceil(sqrt(any_value(shards))))::BIGINT AS grp FROM d GROUP BY source, shard),
 gr AS (SELECT source, grp, sum(shard_size)::BIGINT AS group_size, any_value(source_seats) AS source_seats FROM sh GROUP BY source, grp),
 {apportioned('grw', 'gr', 'source', 'grp', 'group_size', 'source_seats')},
 si AS (SELECT sh.*, grw.won AS group_seats FROM sh JOIN grw ON sh.source IS NOT DISTINCT FROM grw.source AND sh.grp = grw.grp),
 {apportioned('shw', 'si', 'source, grp', 'shard', 'shard_size', 'group_seats')},
 y AS (SELECT d.doc_id, d.size, d.source_size, d.target, shw.shard_size, least(shw.won * {BLOCK_WORDS}, {REPEATS} * shw.shard_size) AS pay,
  sum(d.size) OVER (PARTITION BY d.source, d.shard ORDER BY d.at_, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS a,
  {BLOCK_WORDS} * (('0x' || substr(md5(d.shard::VARCHAR || '@' || coalesce(d.source, '') || ':{SEED}'), 1, 8))::BIGINT % greatest(shw.shard_size // {BLOCK_WORDS}, 1)) AS o
  FROM d JOIN shw ON d.source IS NOT DISTINCT FROM shw.source AND d.shard = shw.shard),
 x AS (SELECT *, pay // greatest(shard_size, 1) AS passes, pay % greatest(shard_size, 1) AS rest, greatest(a, o) - a AS c0 FROM y)
SELECT doc_id, size, source_size, target, (passes * size + greatest(c0, least(a + size, o + rest) - a) - c0 + greatest(0, least(a + size, o + rest - shard_size) - a))::BIGINT AS taken FROM x"""

FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

LINES = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
 l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
 k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {FOLD}) AS key FROM l),
 g AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
 m AS (SELECT k.*, coalesce(doc_id <> owner, FALSE) AS gone FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY r, doc_id"""

TERMS = r"regexp_extract_all(translate(coalesce(text, ''), {0}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')".format(FOLD)
GAP = "((p - q) * (p - q)) // (p + q)"
DIVERGENCE = f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {TERMS} AS ws FROM documents),
 t AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
 c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY ALL),
 k AS (SELECT lang, term, sum(n) AS n_lang FROM c GROUP BY ALL HAVING sum(docs) >= 10),
 v AS (SELECT lang, count(*) AS v, sum(n_lang) AS total FROM k GROUP BY lang),
 g AS (SELECT DISTINCT lang, source FROM d),
 f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n_lang FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
 s AS (SELECT f.*, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY f.lang, f.source) + 2 * v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (n_lang + 2)::HUGEINT) // (total + 2 * v)::HUGEINT AS q FROM f JOIN v ON f.lang = v.lang),
 b AS (SELECT lang, source, item, sum({GAP}) AS value FROM (SELECT x.lang, x.source, y.source AS item, x.p, y.p AS q FROM s x JOIN s y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source) GROUP BY ALL),
 e AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(b.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN b ON b.lang = x.lang AND b.source = x.source AND b.item = y.source
  UNION ALL SELECT lang, source, 'term', term, {GAP} FROM s WHERE n > 0 AND p > q),
 z AS (SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM e)
SELECT * FROM z WHERE part = 'pair' OR rank <= 10"""

#: crc32 of a text of ASCII letters: a byte at a time, eight divisions each.
CRC = "xor(list_reduce(list_transform(string_split({0}, ''), lambda ch: ascii(ch)::BIGINT), lambda acc, b: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(acc, b)), 4294967295), 4294967295)"
TRIE = f"""WITH o AS (SELECT conv_id, list({{'k': k, 'n': n}} ORDER BY turn NULLS FIRST, k) AS ts FROM
  (SELECT conv_id, turn, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
 h AS (SELECT *, ({CRC.format('conv_id::VARCHAR')} % 6)::INTEGER AS h FROM o),
 r AS (SELECT a.conv_id, list_concat(coalesce(b.ts[1:a.h], []), a.ts[a.h + 1:]) AS ts FROM h a LEFT JOIN o b ON b.conv_id = a.conv_id - a.conv_id % 100),
 x AS (SELECT conv_id, len(ts) AS turns, unnest(range(len(ts) + 1)) AS depth, ts FROM r),
 p AS (SELECT conv_id, turns, depth, CASE WHEN depth > 0 THEN array_to_string(list_transform(ts[1:depth], lambda t: t.k), '') ELSE '' END AS pre, CASE WHEN depth > 0 THEN ts[depth].n ELSE 0 END AS size FROM x),
 n AS (SELECT pre, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE turns = depth), '')) AS ends_sha256 FROM p GROUP BY pre, depth),
 c AS (SELECT left(pre, 32 * (depth - 1)::INTEGER) AS up, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
 m AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM n LEFT JOIN c ON c.up = n.pre),
 s AS (SELECT left(pre, 32 * a::INTEGER) AS top, sum((n_children = 0)::INTEGER) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS a FROM m) GROUP BY 1)
SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN s ON s.top = m.pre LEFT JOIN n u ON m.depth > 0 AND u.pre = left(m.pre, 32 * (m.depth - 1)::INTEGER)"""

ORACLES = {"op1_chat_format": CHAT, "op5_source_mix": MIX, "op8_near_duplicates": NEAR, "op11_line_dedup": LINES, "op12_source_divergence": DIVERGENCE, "op13_prefix_trie": TRIE}
