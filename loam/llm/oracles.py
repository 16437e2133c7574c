"""DuckDB SQL for the operators that SQL can express, comparing everything with everything.

The others are tested against brute force, a round trip or held-out accuracy.
"""

from __future__ import annotations

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {}

ORACLES["op2_line_dedup"] = r"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), E'\n') AS lines FROM documents),
l AS (SELECT doc_id, unnest(range(len(lines))) AS i, unnest(lines) AS line FROM s),
u AS (SELECT line, min(struct_pack(d := doc_id, i := i)) AS first FROM l WHERE regexp_matches(line, '[^ \t\r\v\f]') GROUP BY 1),
k AS (SELECT line, first, length(line) - x AS t FROM u, (SELECT unnest([0, 1]) AS x) WHERE length(line) >= 5),
h AS (SELECT *, left(line, t // 2) AS a, right(line, t - t // 2) AS b FROM k),
p AS (SELECT x.line, y.first AS other, x.first, y.line AS line2 FROM h x JOIN h y ON x.t = y.t AND x.a = y.a WHERE y.first < x.first
  UNION SELECT x.line, y.first, x.first, y.line FROM h x JOIN h y ON x.t = y.t AND x.b = y.b WHERE y.first < x.first),
n AS (SELECT DISTINCT line FROM p WHERE abs(length(line) - length(line2)) <= 1 AND levenshtein(line, line2) <= 1),
m AS (SELECT l.doc_id, l.i, l.line, u.first IS NOT NULL AND (u.first != struct_pack(d := l.doc_id, i := l.i) OR n.line IS NOT NULL) AS gone
  FROM l LEFT JOIN u ON u.line = l.line LEFT JOIN n ON n.line = l.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
  sha256(coalesce(string_agg(line, E'\n' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""

ORACLES["op3_embedding_lattice"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id != b.vec_id
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.98),
r AS (SELECT vec_id AS n, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.n)
SELECT n AS vec_id, (SELECT count(*) FROM l WHERE a = n) AS n_links, min(c) AS component_id, n = min(c) AS kept FROM r GROUP BY n
"""

_ESCAPED = r"regexp_replace({}, '<(\\*)\|', '<\1\\|', 'g')"
ORACLES["op4_chat_format"] = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || E'\n' || text || E'\n', '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(role) + 1 + length({_ESCAPED.format('text')}) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars,
  regexp_full_match(string_agg(role, ' ' ORDER BY turn, role, text), '(system )?user assistant( user assistant)*') AS complete
FROM t GROUP BY conv_id
"""

ORACLES["op7_ngram_jaccard"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(greatest(len(w) - 2, 1)),
  lambda i: array_to_string(w[i + 1:i + 3], ' '))) END AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n, b.n AS m, count(*) AS i FROM g a JOIN g b ON a.g = b.g AND a.doc_id != b.doc_id GROUP BY 1, 2, 3, 4),
l AS (SELECT a, b FROM o WHERE 100 * i >= 90 * (n + m - i)),
r AS (SELECT doc_id AS n, doc_id AS c FROM s UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.n)
SELECT r.n AS doc_id, any_value(len(s.s))::BIGINT AS n_shingles, min(c) AS component_id FROM r JOIN s ON s.doc_id = r.n GROUP BY 1
"""

ORACLES["op8_substring_dedup"] = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word, w FROM w),
q AS (SELECT doc_id, i, word, CASE WHEN i + 19 <= len(w) THEN array_to_string(w[i:i + 19], ' ') END AS k FROM p),
d AS (SELECT doc_id, i, word, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS again FROM q),
c AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM d),
a AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS g, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0) AS n_words, coalesce(g, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN a ON a.doc_id = w.doc_id
"""

_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda r, b: list_reduce(list_prepend(xor(r, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda s, z: xor(s >> 1, 3988292384 * (s & 1)))))"""
ORACLES["op13_periodic_runs"] = f"""
WITH t AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w, {_CRC32} AS h FROM documents),
u AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g, CASE WHEN len(w) > 0 THEN h // 10 % len(w) END AS a FROM t),
v AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM u),
i AS (SELECT doc_id, n, w, h, a, p, unnest(range(n)) AS i FROM v),
x AS (SELECT doc_id, n, i, w[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS word FROM i),
e AS (SELECT b.doc_id, c.i - b.i AS q, b.i FROM x b JOIN x c ON b.doc_id = c.doc_id AND b.word = c.word AND c.i > b.i AND c.i - b.i <= b.n // 2),
s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS stretch FROM e),
m AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY doc_id, q, stretch HAVING count(*) + q >= greatest(12, 2 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM m GROUP BY ALL),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS kept FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i WHERE gone.i IS NULL GROUP BY 1),
b AS (SELECT doc_id, count(*) AS n, string_agg(start || ',' || length || ',' || period || E'\n', '' ORDER BY start, period) AS runs,
  arg_max(struct_pack(start, length, period), [length, -start, -period]) AS best FROM r GROUP BY 1)
SELECT t.doc_id, coalesce(b.n, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period,
  1000 * best.length // best.period AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN b ON b.doc_id = t.doc_id LEFT JOIN k ON k.doc_id = t.doc_id
"""

ORACLES["op12_cover_tree"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score FROM v q JOIN v ON q.vec_id != v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""
