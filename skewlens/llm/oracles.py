"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLES = {
    "op4_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), r AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), m AS (
  SELECT k.doc_id, k.i, k.line, r.key IS NOT NULL AND k.doc_id > r.first AS dropped
  FROM k LEFT JOIN r ON k.key = r.key AND length(k.key) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
    "op5_perspectives": r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text,
         coalesce(CAST(floor(turn / 256.0) AS BIGINT), -1) AS segment
  FROM conversations
), c AS (
  SELECT coalesce(CAST(floor(turn / 256.0) AS BIGINT), -1) AS segment, conv_id, count(*) > 1024 AS crowded FROM conversations GROUP BY ALL
), r AS (
  SELECT t.*, CASE WHEN c.crowded THEN (row_number() OVER (PARTITION BY t.conv_id, t.segment ORDER BY t.turn NULLS FIRST, t.role, t.text) - 1) // 256
         ELSE 0 END AS part
  FROM t JOIN c ON t.conv_id IS NOT DISTINCT FROM c.conv_id AND t.segment = c.segment
), s AS (
  SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'
), p AS (
  SELECT r.*, speaker, role = speaker AS trained,
         CASE WHEN role = speaker THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>' ELSE '<|user name=' || role || '|>' END || chr(10) AS head,
         text || '<|end|>' || chr(10) AS body
  FROM r JOIN s ON r.conv_id IS NOT DISTINCT FROM s.conv_id
), e AS (
  SELECT *, sum(length(head) + length(body)) OVER (
    PARTITION BY conv_id, speaker, segment, part ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS stop,
    sum(length(head) + length(body)) OVER (
    PARTITION BY conv_id, speaker ORDER BY segment, part, turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS whole
  FROM p
)
SELECT conv_id, speaker, segment, part, CAST(min(whole - stop) AS BIGINT) AS start, count(*) AS n_turns, count(*) FILTER (trained) AS n_trained,
       string_agg(head || body, '' ORDER BY stop) AS text,
       coalesce(string_agg((stop - length(body)) || ':' || stop, ',' ORDER BY stop) FILTER (trained), '') AS mask
FROM e GROUP BY conv_id, speaker, segment, part
""",
    "op10_host_rules": r"""
WITH w AS (
  SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), i AS (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5
), p AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_slice(w, i, i + 4)) AS n FROM i
), c AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM p WHERE n > 1) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN c ON w.doc_id = c.doc_id
), f AS (
  SELECT *, n_words < 10 AS short, 100 * n_repeat_words > 20 * n_words AS repeats,
         100 * n_symbols > 10 * word_chars AS symbols, 100 * n_dup_lines > 30 * n_lines AS lines
  FROM m
), h AS (
  SELECT source, rule, count(*) AS n, sum(CAST(failed AS BIGINT)) AS bad
  FROM (SELECT source, unnest(['short', 'repeats', 'symbols', 'lines']) AS rule, unnest([short, repeats, symbols, lines]) AS failed FROM f)
  GROUP BY source, rule
), a AS (
  SELECT rule, sum(bad) / sum(n) AS mean, sum(bad * bad / n) / sum(n) - (sum(bad) / sum(n)) ** 2 AS var FROM h GROUP BY rule
), b AS (
  SELECT rule, mean, CASE WHEN var <= 0 THEN 1e6 ELSE least(1e6, greatest(1.0, mean * (1 - mean) / var - 1)) END AS weight FROM a
), v AS (
  SELECT source, max((bad + mean * weight) / (n + weight)) > 0.5 AS rejected,
         max((bad + mean * weight) / (n + weight)) FILTER (rule = 'short') AS r1, max((bad + mean * weight) / (n + weight)) FILTER (rule = 'repeats') AS r2,
         max((bad + mean * weight) / (n + weight)) FILTER (rule = 'symbols') AS r3, max((bad + mean * weight) / (n + weight)) FILTER (rule = 'lines') AS r4
  FROM h JOIN b USING (rule) GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed,
       NOT (short OR repeats) AND NOT rejected AS kept, rejected AS host_rejected, symbols, lines,
       round(r1, 6) AS short_rate, round(r2, 6) AS repeats_rate, round(r3, 6) AS symbols_rate, round(r4, 6) AS lines_rate
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
""",
    "op11_suffix_dedup": r"""
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS t, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, i, t[i + 1:i + 50] AS s FROM (SELECT doc_id, t, unnest(range(octet_length(t) - 49)) AS i FROM d)
), f AS (
  SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING count(*) > 1
), g AS (
  SELECT w.doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY w.doc_id ORDER BY i) + 50, true) AS starts
  FROM w JOIN f USING (s) WHERE w.doc_id > first
), n AS (
  SELECT doc_id, i, sum(CAST(starts AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g
), s AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM n GROUP BY doc_id, span
), k AS (
  SELECT doc_id, h, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM d LEFT JOIN s USING (doc_id)
)
SELECT doc_id, any_value(length(h)) // 2 AS n_bytes, CAST(coalesce(sum(b - a), 0) AS BIGINT) AS n_removed, count(a) AS n_spans,
       sha256(unhex(string_agg(substring(h, 2 * before + 1, 2 * (coalesce(a, length(h) // 2) - before)), '' ORDER BY a)
                    || substring(any_value(h), 2 * coalesce(max(b), length(any_value(h)) // 2) + 1))) AS kept_sha256
FROM k GROUP BY doc_id
""",
    "op13_phrases": r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id,
         unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t
), x AS (
  SELECT lang, p, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM w
), g AS (
  SELECT lang, a, lead(a) OVER (PARTITION BY p ORDER BY i) AS b, lead(a, 2) OVER (PARTITION BY p ORDER BY i) AS c FROM x
), f AS (
  SELECT lang, 1 AS k, a AS phrase, count(*) AS f FROM g GROUP BY ALL
  UNION ALL SELECT lang, 2, a || ' ' || b, count(*) FROM g WHERE b IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c, count(*) FROM g WHERE c IS NOT NULL GROUP BY ALL
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10
), s AS (
  SELECT lang, k, phrase, a, cut, lang || chr(10) || array_to_string(w[1:cut], ' ') AS head, lang || chr(10) || array_to_string(w[cut + 1:], ' ') AS rest
  FROM c, unnest(range(1, k)) AS u(cut)
), h AS MATERIALIZED (  -- one key, so that no join is on the language alone
  SELECT lang || chr(10) || phrase AS key, f FROM f
), v AS (
  SELECT s.lang, s.phrase, a, cut, p1.f AS l, p2.f AS r,
         CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(p1.f AS HUGEINT) * p2.f) AS BIGINT) AS score
  FROM s JOIN h p1 ON s.head = p1.key JOIN h p2 ON s.rest = p2.key
), b AS (
  SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), o AS (
  SELECT lang, phrase, max(a) AS longest FROM (
    SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a FROM c WHERE k = 3) GROUP BY ALL
), m AS (
  SELECT b.lang, b.phrase, a, l, r, score, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank
  FROM b LEFT JOIN o ON b.lang = o.lang AND b.phrase = o.phrase WHERE longest IS NULL OR 100 * longest < 50 * a
)
SELECT m.lang, rank, phrase, a, l, r, n, score FROM m JOIN n USING (lang) WHERE rank <= 2000
""",
}
