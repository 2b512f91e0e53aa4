"""DuckDB statements for the operators that SQL expresses; the others are tested against brute force."""

from __future__ import annotations

OP4 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), p AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle FROM p
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n
  HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))
), r(x, y) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y
), c AS (
  SELECT x, min(y) AS component_id FROM r GROUP BY x
)
SELECT d.doc_id AS doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.x = d.doc_id
"""

OP7 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, p.vec_id AS vec_id, CAST(list_dot_product(q.v, p.v) AS BIGINT) AS score
  FROM v q JOIN v p ON p.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

REPEATED = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS passage FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY passage ORDER BY doc_id, i) AS n, count(*) OVER (PARTITION BY passage) AS m FROM p),
c AS (SELECT doc_id, unnest(range(i, i + 50)) AS word, n > 1 AS later FROM r WHERE m > 1),
u AS (SELECT doc_id, count(DISTINCT word) AS n_repeated, count(DISTINCT word) FILTER (WHERE later) AS n_cut FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_repeated, 0) AS n_repeated, coalesce(n_cut, 0) AS n_cut FROM d LEFT JOIN u ON u.doc_id = d.doc_id
"""

PERSONAL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS e, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS i,
  list_transform(regexp_extract_all(t, '[0-9]([ -]?[0-9])+'), lambda x: reverse(regexp_replace(x, '[^0-9]', '', 'g'))) AS c, list_transform(regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]'), lambda x: len(regexp_replace(x, '[^0-9]', '', 'g'))) AS p FROM t)
SELECT doc_id, CAST(len(e) AS BIGINT) AS n_email, CAST(len(list_filter(i, lambda x: list_max(list_transform(string_split(x, '.'), lambda y: coalesce(try_cast(y AS HUGEINT), 999))) <= 255)) AS BIGINT) AS n_ip,
  CAST(len(list_filter(c, lambda x: len(x) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, len(x) + 1), lambda k: CASE WHEN k % 2 = 1 THEN CAST(x[k] AS INTEGER) WHEN x[k] > '4' THEN 2 * CAST(x[k] AS INTEGER) - 9 ELSE 2 * CAST(x[k] AS INTEGER) END)) % 10 = 0)) AS BIGINT) AS n_card,
  CAST(len(list_filter(p, lambda x: x BETWEEN 9 AND 15)) AS BIGINT) AS n_phone FROM m
"""

RULES = r"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
b AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM a),
r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS n FROM b JOIN r ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p))
SELECT b.page_id, host, path, rule, v AS ruled FROM b LEFT JOIN f ON f.page_id = b.page_id AND n = 1
"""

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
g AS (SELECT doc_id, i, w[i:i + 2] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
m AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT word) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS word FROM m WHERE n > 1) GROUP BY doc_id),
c AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
"""

PACKED = rf"""
WITH d AS (SELECT doc_id, len({WORDS}) AS n FROM documents), p AS (SELECT doc_id, n, unnest(range(0, (n + 4095) // 4096)) AS piece FROM d WHERE n > 0)
SELECT doc_id, CAST(piece AS INTEGER) AS piece, CAST(least(4096, n - 4096 * piece) AS BIGINT) AS n_words, true AS fits FROM p
"""


CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations UNION ALL
  SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'
), k(mark) AS (VALUES ('<|turn|>'), ('<|text|>'), ('</s>'), ('<s>'), ('[INST]'), ('[/INST]'), ('\')),
e AS (
  SELECT *, 20 + length(r) + length(x) + (SELECT sum((length(r) - length(replace(r, mark, '')) + length(x) - length(replace(x, mark, ''))) // length(mark)) FROM k) AS chars FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r)) AS turns_sha256,
  CAST(coalesce(sum(length(x)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def crc32(text: str) -> str:
    """The CRC-32 of an ASCII string."""
    bits = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: {bits}), 4294967295)"


REPAIR = rf"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS x, {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations
), d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE r END AS r, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(x, '.!?', '') ELSE x END AS x, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM t WHERE kind <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x, copy) AS i FROM d
), f AS (
  SELECT *, left(r, 1) AS c, CASE WHEN NOT regexp_matches(x, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, r, x ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(x, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    lag(left(r, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(r, 1) NOT IN ('su', 'ua', 'au') AS illegal FROM o
), w(conv_id, i, state, best) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, '0', {{'cost': 0::BIGINT, 'audit': ''}} FROM f
  UNION ALL
  SELECT conv_id, i, goes, min({{'cost': cost, 'audit': audit}}) FROM (
    SELECT w.conv_id, f.i, edit,
      CASE WHEN ins = '' THEN state WHEN state = 'u' THEN 'a' ELSE 'u' END AS here,
      CASE WHEN edit = 'D' THEN here WHEN edit = 'R' THEN CASE WHEN here = 'u' THEN 'a' ELSE 'u' END WHEN c = 's' AND here = '0' THEN 's' WHEN c = 'u' AND here <> 'u' THEN 'u' WHEN c = 'a' AND here = 'u' THEN 'a' END AS goes,
      best.cost + 3 * length(ins) + CASE edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END AS cost, best.audit || ins || edit AS audit
    FROM w JOIN f ON f.conv_id = w.conv_id AND f.i = w.i + 1, (VALUES ('K'), ('R'), ('D')) e(edit), (VALUES (''), ('I')) n(ins)
    WHERE edit = 'D' OR fault NOT IN ('blank', 'duplicate')
  ) WHERE goes IS NOT NULL GROUP BY conv_id, i, goes
), n AS (
  SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE illegal) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM f GROUP BY conv_id
), b AS (
  SELECT w.conv_id, min({{'cost': best.cost + CASE state WHEN 's' THEN 6 WHEN 'u' THEN 3 ELSE 0 END, 'audit': best.audit || CASE state WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END}}) AS best
  FROM w JOIN n ON n.conv_id = w.conv_id AND n.n = w.i GROUP BY w.conv_id
), l AS (
  SELECT conv_id, unnest(range(1, length(best.audit) + 1)) AS p, best.audit[p] AS edit, length(replace(best.audit[:p], 'I', '')) AS i FROM b
), m AS (
  SELECT l.*, f.r, f.c, f.x, row_number() OVER (PARTITION BY l.conv_id ORDER BY p) AS place, bool_or(edit = 'K' AND c = 's') OVER (PARTITION BY l.conv_id) AS system
  FROM l LEFT JOIN f ON f.conv_id = l.conv_id AND f.i = l.i WHERE edit <> 'D'
), h AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN r WHEN (place - system::INTEGER) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE x END, chr(10) ORDER BY place)) AS sha FROM m GROUP BY conv_id
)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost,
  coalesce(best.audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id = a.conv_id LEFT JOIN b ON b.conv_id = a.conv_id LEFT JOIN h ON h.conv_id = a.conv_id
"""

RUNS = rf"""
WITH t AS (SELECT doc_id, {WORDS} AS w, {crc32("doc_id::VARCHAR")} AS h FROM documents),
g AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM t),
p AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM g),
x AS (SELECT doc_id, n, i, w[i + 1] AS word FROM (SELECT doc_id, w, len(w) AS n, unnest(range(len(w))) AS i FROM p)),
e AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS stretch FROM e),
r AS (SELECT doc_id, min(i) AS start, count(*) + q AS length, q AS period FROM s GROUP BY doc_id, q, stretch HAVING count(*) + q >= greatest(6, 4 * q)),
u AS (SELECT doc_id, start, length, min(period) AS period FROM r GROUP BY doc_id, start, length),
k AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM u),
c AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS kept FROM x LEFT JOIN k ON k.doc_id = x.doc_id AND k.i = x.i WHERE k.i IS NULL GROUP BY x.doc_id),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS best FROM u),
z AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM u GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN z ON z.doc_id = t.doc_id LEFT JOIN b ON b.doc_id = t.doc_id AND best = 1 LEFT JOIN c ON c.doc_id = t.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_ngram_jaccard_join": OP4, "op7_exact_top_k": OP7, "repeated_words": REPEATED, "personal_data_counts": PERSONAL, "url_rules": RULES, "quality_counts": QUALITY, "packed_words": PACKED,
        "op11_chat_format": CHAT, "op12_conversation_repair": REPAIR, "op13_periodic_runs": RUNS,
    }
