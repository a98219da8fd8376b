"""DuckDB SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

#: A word and white space as the operators mean them, in DuckDB's regular expressions.
_WORD = "[^\\x20\\x09-\\x0D]+"
_WS = "[\\x20\\x09-\\x0D]"


def _normalised(column: str) -> str:
    return f"list_filter(string_split(trim(regexp_replace(lower(coalesce({column}, '')), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), ' '), lambda x: x <> '')"


ORACLES: dict[str, str] = {
    "op3_line_spread": f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents
), spread AS (
  SELECT regexp_replace(line, '^{_WS}+|{_WS}+$', '', 'g') AS line FROM lines
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]+{_WS}+[^\\x20\\x09-\\x0D]+{_WS}+[^\\x20\\x09-\\x0D]')
  GROUP BY 1 HAVING count(DISTINCT source) >= 10
), all_lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS place, unnest(string_split(text, chr(10))) AS line FROM documents
), marked AS (
  SELECT doc_id, place, a.line, s.line IS NOT NULL AS gone
  FROM all_lines a LEFT JOIN spread s ON regexp_replace(a.line, '^{_WS}+|{_WS}+$', '', 'g') = s.line
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
       md5(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_md5
FROM marked GROUP BY doc_id""",
    "op6_decontamination": f"""
WITH d AS (SELECT doc_id, {_normalised('text')} AS words FROM documents
), b AS (SELECT item_id, words, least(len(words), 13) AS size, least(len(words), 13) - 2 * least(len(words), 13) // 13 AS need FROM (SELECT item_id, {_normalised('text')} AS words FROM benchmark)
), dw AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p, len(words) AS n FROM d
), bw AS (SELECT item_id, unnest(words) AS word, generate_subscripts(words, 1) AS q, len(words) AS m, size, need FROM b
), same AS (SELECT doc_id, item_id, p - q AS shift, q, n, m, size, need FROM dw JOIN bw USING (word) WHERE m >= 5 OR n = m
), dense AS (SELECT * FROM same QUALIFY count(*) OVER (PARTITION BY doc_id, item_id, shift) >= need
), starts AS (SELECT DISTINCT doc_id, item_id, shift, q - k AS start, n, m, size, need FROM dense, range(13) r(k) WHERE k < size
), good AS (SELECT s.doc_id, s.item_id, s.shift, s.start, s.size FROM starts s JOIN dense d ON d.doc_id = s.doc_id AND d.item_id = s.item_id AND d.shift = s.shift AND d.q BETWEEN s.start AND s.start + s.size - 1
  WHERE s.start >= 1 AND s.start + s.size - 1 <= s.m AND s.start + s.shift >= 1 AND s.start + s.shift + s.size - 1 <= s.n GROUP BY s.doc_id, s.item_id, s.shift, s.start, s.size, s.need HAVING count(*) >= s.need
), covered AS (SELECT doc_id, item_id, shift, count(DISTINCT start + k) AS words FROM good, range(13) r(k) WHERE k < size GROUP BY 1, 2, 3
), found AS (SELECT doc_id, item_id, max(words) AS words FROM covered GROUP BY 1, 2
), by_doc AS (SELECT doc_id, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS item_ids, max(words) AS words FROM found GROUP BY 1)
SELECT doc_id, b.doc_id IS NOT NULL AS contaminated, coalesce(item_ids, '') AS item_ids, coalesce(words, 0) AS words FROM documents LEFT JOIN by_doc b USING (doc_id)""",
    "op7_preferences": """
WITH ranked AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER w AS place, lag(text) OVER w AS before
  FROM conversations WHERE conv_id IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), ended AS (
  SELECT *, max(CASE WHEN role = 'assistant' AND before IS NOT NULL THEN place END) OVER (PARTITION BY conv_id) AS last FROM ranked
), sides AS (
  SELECT conv_id AS pair_id, place, role, true AS chosen, text FROM ended WHERE last IS NOT NULL
  UNION ALL
  SELECT conv_id, place, role, false, CASE WHEN place = last THEN before ELSE text END FROM ended WHERE place <= last
), differing AS (
  SELECT c.pair_id, min(c.place) AS first_diff
  FROM (SELECT * FROM sides WHERE chosen) c LEFT JOIN (SELECT * FROM sides WHERE NOT chosen) r ON c.pair_id = r.pair_id AND c.place = r.place
  WHERE r.place IS NULL OR c.text <> r.text OR c.role <> r.role GROUP BY 1
), rendered AS (
  SELECT s.*, coalesce(first_diff, 1000000000) AS cut, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS piece,
         length(role) + 5 AS head
  FROM sides s LEFT JOIN differing d USING (pair_id)
), placed AS (
  SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY pair_id, chosen ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun
  FROM rendered WHERE place >= cut
), prompts AS (
  SELECT pair_id, count(*) FILTER (place < cut) AS prefix_turns, coalesce(string_agg(piece, '' ORDER BY place) FILTER (place < cut), '') AS prompt
  FROM rendered WHERE chosen GROUP BY 1
), completed AS (
  SELECT pair_id,
    coalesce(string_agg(piece, '' ORDER BY place) FILTER (chosen), '') AS chosen,
    coalesce(string_agg(piece, '' ORDER BY place) FILTER (NOT chosen), '') AS rejected,
    coalesce(string_agg((begun + head)::BIGINT || '-' || (begun + length(piece))::BIGINT, ',' ORDER BY place) FILTER (chosen AND role = 'assistant'), '') AS chosen_mask,
    coalesce(string_agg((begun + head)::BIGINT || '-' || (begun + length(piece))::BIGINT, ',' ORDER BY place) FILTER (NOT chosen AND role = 'assistant'), '') AS rejected_mask
  FROM placed GROUP BY 1
)
SELECT p.pair_id, prefix_turns, prompt, coalesce(chosen, '') AS chosen, coalesce(rejected, '') AS rejected,
       coalesce(chosen_mask, '') AS chosen_mask, coalesce(rejected_mask, '') AS rejected_mask
FROM prompts p LEFT JOIN completed USING (pair_id)""",
    "op8_minhash_near_dups": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS words FROM documents
), s AS (SELECT DISTINCT doc_id, array_to_string(words[place:place + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS place FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), classes AS (SELECT doc_id, n, md5(string_agg(shingle, chr(10) ORDER BY shingle)) AS class FROM s JOIN n USING (doc_id) GROUP BY 1, 2
), reps AS (SELECT class, min(doc_id) AS rep, any_value(n) AS n FROM classes GROUP BY 1
), pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b USING (shingle) JOIN reps ra ON ra.rep = a.doc_id JOIN reps rb ON rb.rep = b.doc_id
  WHERE a.doc_id < b.doc_id AND 100 * least(ra.n, rb.n) >= 85 * greatest(ra.n, rb.n) GROUP BY 1, 2
), links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 85 * (a.n + b.n - common)
), edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links
), reach(node, other) AS (SELECT rep, rep FROM reps UNION SELECT r.node, e.y FROM reach r JOIN edges e ON e.x = r.other
), label AS (SELECT node, min(other) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN classes c USING (doc_id) LEFT JOIN reps USING (class) LEFT JOIN label ON label.node = rep""",
    "op9_substring_dedup": f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents
), p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM w
), win AS (SELECT doc_id, place, array_to_string(words[place:place + 12], ' ') AS window_text
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS place FROM w WHERE len(words) >= 13)
), first AS (SELECT window_text, min(doc_id) AS first_doc FROM win GROUP BY 1 HAVING count(DISTINCT doc_id) > 1
), gone AS (SELECT DISTINCT doc_id, place + k AS place FROM win JOIN first USING (window_text), range(13) r(k) WHERE doc_id > first_doc
), kept AS (SELECT p.doc_id, count(*) AS n_words, count(g.place) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p.place) FILTER (g.place IS NULL), '') AS kept
  FROM p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.place = g.place GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN kept USING (doc_id)""",
    "op10_quality_rules": f"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents
), l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '{_WORD}') GROUP BY 1
), t AS (SELECT doc_id, place, array_to_string(words[place:place + 2], ' ') AS triple FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS place FROM w WHERE len(words) >= 3)
), r AS (SELECT doc_id, triple FROM t GROUP BY 1, 2 HAVING count(*) > 1
), marked AS (SELECT doc_id, count(DISTINCT place + k) AS n_repeat_words FROM t JOIN r USING (doc_id, triple), range(3) s(k) GROUP BY 1
), base AS (SELECT w.doc_id, lang, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN l USING (doc_id) LEFT JOIN marked USING (doc_id)
), m AS (SELECT *, coalesce(n_symbols * 1000 // nullif(word_chars, 0), 0) AS symbol_mille, coalesce(n_dup_lines * 1000 // nullif(n_lines, 0), 0) AS dup_line_mille,
    coalesce(n_repeat_words * 1000 // nullif(n_words, 0), 0) AS repeat_mille, coalesce(word_chars * 100 // nullif(n_words, 0), 0) AS word_len_cents FROM base
), long AS (SELECT lang, source, unnest(['symbol_mille', 'dup_line_mille', 'repeat_mille', 'word_len_cents', 'word_chars', 'n_lines', 'n_words']) AS metric,
    unnest([symbol_mille, dup_line_mille, repeat_mille, word_len_cents, word_chars, n_lines, n_words]) AS value FROM m
), levels AS (SELECT 2 AS level, lang, source, metric, value FROM long UNION ALL SELECT 1, lang, NULL, metric, value FROM long UNION ALL SELECT 0, NULL, NULL, metric, value FROM long
), sketch AS (SELECT level, lang, source, metric, CASE WHEN value < 128 THEN value ELSE (value >> (length(bin(value)) - 7)) << (length(bin(value)) - 7) END AS bucket, count(*) AS n FROM levels GROUP BY ALL
), ranked AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS below, sum(n) OVER (PARTITION BY level, lang, source, metric) AS total FROM sketch
), points AS (SELECT level, lang, source, metric, max(total)::BIGINT AS n, min(bucket) FILTER (below >= total * 0.25) AS q25, min(bucket) FILTER (below >= total * 0.5) AS q50 FROM ranked GROUP BY ALL
), rules(metric, spread, allowance, size, least_size, most) AS (VALUES ('symbol_mille', 8, 16000, 'word_chars', 300, 1000), ('dup_line_mille', 8, 2000, 'n_lines', 5, 1000),
    ('repeat_mille', 8, 54000, 'n_words', 75, 1000), ('word_len_cents', 12, 0, 'n_words', 50, NULL)
), own AS (SELECT p.level, p.lang, p.source, p.metric, p.n, least(p.q50 + spread * (p.q50 - p.q25) + allowance // greatest(s.q50, least_size), coalesce((p.q50 + most) // 2, 9223372036854775807)) AS limit_
  FROM points p JOIN rules r ON r.metric = p.metric JOIN points s ON s.level = p.level AND s.lang IS NOT DISTINCT FROM p.lang AND s.source IS NOT DISTINCT FROM p.source AND s.metric = r.size
), top AS (SELECT metric, limit_ FROM own WHERE level = 0
), by_lang AS (SELECT o.lang, o.metric, least((o.n * o.limit_ + 100 * t.limit_) // (o.n + 100), 2 * t.limit_) AS limit_ FROM own o JOIN top t ON t.metric = o.metric WHERE o.level = 1
), lim AS (SELECT o.lang, o.source, o.metric, least((o.n * o.limit_ + 100 * b.limit_) // (o.n + 100), 2 * b.limit_) AS limit_
  FROM own o JOIN by_lang b ON b.metric = o.metric AND b.lang IS NOT DISTINCT FROM o.lang WHERE o.level = 2
), wide AS (SELECT lang, source, max(limit_) FILTER (metric = 'symbol_mille') AS a, max(limit_) FILTER (metric = 'dup_line_mille') AS b, max(limit_) FILTER (metric = 'repeat_mille') AS c, max(limit_) FILTER (metric = 'word_len_cents') AS d FROM lim GROUP BY ALL
)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, symbol_mille, dup_line_mille, repeat_mille, word_len_cents,
  a::BIGINT AS limit_symbol_mille, b::BIGINT AS limit_dup_line_mille, c::BIGINT AS limit_repeat_mille, d::BIGINT AS limit_word_len_cents,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND symbol_mille <= a AND dup_line_mille <= b AND repeat_mille <= c AND word_len_cents <= d AS kept
FROM m LEFT JOIN wide w ON w.lang IS NOT DISTINCT FROM m.lang AND w.source IS NOT DISTINCT FROM m.source""",
}
