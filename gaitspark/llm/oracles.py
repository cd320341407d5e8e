"""DuckDB SQL for the operators that SQL can express."""

#: White space of words and line ends, as an SQL expression.
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {}

SQL["op5_url_filters"] = f"""
WITH rules(verdict, r_host, r_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, {LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (
  SELECT p.page_id, r.*, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r_host) + length(r_path) DESC) AS rank
  FROM parts p JOIN rules r ON (p.host = r_host OR ends_with(p.host, '.' || r_host)) AND starts_with(p.path, r_path))
SELECT p.page_id, p.host, p.path, f.r_host || f.r_path AS rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.rank = 1
"""

SQL["op6_line_dedup"] = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, {LOWER.format(f"trim(line, {BLANKS})")} AS key FROM lines),
common AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, c.keeper IS NOT NULL AND c.keeper <> k.doc_id AS gone FROM keyed k LEFT JOIN common c USING (key))
SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

WORD_LIST_OF = "CASE WHEN trim({0}, {1}) = '' THEN []::VARCHAR[] ELSE regexp_split_to_array(trim({0}, {1}), '[\\x20\\x09-\\x0D]+') END"
WORD_LIST = WORD_LIST_OF.format("lower(coalesce(text, ''))", BLANKS)
LOWERED_WORDS = WORD_LIST_OF.format(LOWER.format("coalesce(text, '')"), BLANKS)
WORDS = WORD_LIST_OF.format("coalesce(text, '')", BLANKS)

SQL["op8_contained_benchmarks"] = f"""
WITH item_words AS (SELECT item_id, {WORD_LIST} AS w FROM benchmark),
item_windows AS (SELECT item_id, w, least(len(w), 5) AS k FROM item_words WHERE len(w) > 0),
item_shingles AS (
  SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS s
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM item_windows)),
sizes AS (SELECT item_id, count(*) AS n_shingles FROM item_shingles GROUP BY item_id),
doc_words AS (SELECT doc_id, {WORD_LIST} AS w FROM documents),
doc_shingles AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[p : p + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM doc_words, (SELECT DISTINCT k FROM item_shingles))),
found AS (SELECT doc_id, item_id, count(*) AS n_found FROM doc_shingles JOIN item_shingles USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_found FROM found JOIN sizes USING (item_id) WHERE 100 * n_found >= 80 * n_shingles
"""

SQL["op3_jaccard_components"] = f"""
WITH RECURSIVE doc_words AS (SELECT doc_id, {LOWERED_WORDS} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, least(len(w), 3) AS k, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS p FROM doc_words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT x, y FROM (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL)
  JOIN sizes sx ON sx.doc_id = x JOIN sizes sy ON sy.doc_id = y WHERE 100 * shared >= 90 * (sx.n + sy.n - shared)),
reached(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(r.y) AS component_id
FROM documents d JOIN reached r ON r.x = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""

COVERAGES = {5: "0.40", 6: "0.38", 8: "0.34", 10: "0.30"}
GRAMS = ", ".join("concat_ws(' ', word, " + ", ".join(f"lead(word, {i}) OVER in_text" for i in range(1, k)) + f") AS g{k}, lead(p, {k - 1}) OVER in_text IS NOT NULL AS whole{k}" for k in COVERAGES)
TWICE = ", ".join(f"whole{k} AND count(*) OVER (PARTITION BY doc_id, whole{k}, g{k}) > 1 AS d{k}" for k in COVERAGES)
INSIDE = ", ".join(f"bool_or(d{k}) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS c{k}" for k in COVERAGES)
COVERED = ", ".join(f"sum(length(word)) FILTER (c{k}) AS c{k}" for k in COVERAGES)
FINE = " AND ".join(f"coalesce(c{k}, 0) / greatest(1, word_chars) <= {most}::DOUBLE" for k, most in COVERAGES.items())

SQL["op4_repetition_coverage"] = f"""
WITH doc_words AS (SELECT doc_id, {WORDS} AS w FROM documents),
text_words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM doc_words),
grams AS (SELECT doc_id, p, word, {GRAMS} FROM text_words WINDOW in_text AS (PARTITION BY doc_id ORDER BY p)),
twice AS (SELECT doc_id, p, word, {TWICE} FROM grams),
inside AS (SELECT doc_id, word, {INSIDE} FROM twice),
by_words AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars, count_if(c8) AS n_repeat_words, {COVERED} FROM inside GROUP BY doc_id),
lines AS (
  SELECT doc_id, regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g') AS packed, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS nth
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
by_lines AS (SELECT doc_id, count(*) AS n_dup_lines, sum(length(packed)) AS line_chars FROM lines WHERE nth > 1 AND packed <> '' GROUP BY doc_id),
counted AS (
  SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, line_chars, {", ".join(f"c{k}" for k in COVERAGES)}
  FROM documents d LEFT JOIN by_words USING (doc_id) LEFT JOIN by_lines USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(line_chars, 0) / greatest(1, word_chars) <= 0.30::DOUBLE AND n_symbols <= 0.25::DOUBLE * n_words AND {FINE} AS kept
FROM judged
"""

SHARE = "(1 + (1000000000::HUGEINT * ({0} + 2)) // ({1} + 2 * {2}))"
APART = "(({0} - {1}) * ({0} - {1}) // ({0} + {1}))"

# every pair of sources and every kept term, zero counts written out
SQL["op11_source_divergence"] = f"""
WITH docs AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, {LOWER.format("coalesce(text, '')")} AS text FROM documents),
terms AS (SELECT lang, source, regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM docs),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(t)) AS term FROM terms) GROUP BY ALL HAVING count(*) >= 10),
held AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(t) AS term FROM terms) JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source, coalesce(v, 0) AS v FROM docs LEFT JOIN sizes USING (lang)),
totals AS (SELECT g.*, coalesce(sum(n), 0)::HUGEINT AS total FROM groups g LEFT JOIN held USING (lang, source) GROUP BY ALL),
cells AS (SELECT g.lang, g.source, term, coalesce(n, 0) AS n, {SHARE.format("coalesce(n, 0)", "total", "v")} AS p FROM totals g JOIN kept USING (lang) LEFT JOIN held USING (lang, source, term)),
whole AS (SELECT lang, v, sum(total) AS total FROM totals GROUP BY ALL),
of_lang AS (SELECT lang, term, {SHARE.format("sum(n)", "any_value(total)", "any_value(v)")} AS q FROM held JOIN whole USING (lang) GROUP BY lang, term),
apart AS (SELECT a.lang, a.source, b.source AS item, sum({APART.format("a.p", "b.p")}) AS value FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
tops AS (SELECT lang, source, 'term' AS part, term AS item, {APART.format("p", "q")}::BIGINT AS value FROM cells JOIN of_lang USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM tops)
QUALIFY part = 'pair' OR rank <= 10
"""

#: CRC-32 of a hexadecimal string's bytes by a table of 256 remainders, made from its polynomial.
CRC_TABLE = "SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc"
CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length({0}), 2), lambda i: ('0x' || substr({0}, i, 2))::BIGINT)), lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])), 4294967295)"
RUNS_OF_WORDS = f"SELECT {{id}} AS id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {{table}}"

SQL["op12_target_resampling"] = f"""
WITH words AS (SELECT 'd' AS side, * FROM ({RUNS_OF_WORDS.format(id="doc_id", table="documents")}) UNION ALL SELECT 'b', * FROM ({RUNS_OF_WORDS.format(id="item_id", table="benchmark")})),
placed AS (SELECT side, id, w, unnest(range(1, len(w) + 1)) AS p FROM words),
features AS (SELECT side, id, w[p] AS f FROM placed UNION ALL SELECT side, id, w[p] || ' ' || w[p + 1] FROM placed WHERE p < len(w)),
hashed AS (SELECT f, {CRC.format("h")} % 10000 AS bucket FROM (SELECT f, hex(f) AS h FROM (SELECT DISTINCT f FROM features)), ({CRC_TABLE})),
counts AS (SELECT bucket, count_if(side = 'd') AS s, count_if(side = 'b') AS t FROM features JOIN hashed USING (f) GROUP BY bucket),
sums AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM counts),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1) * (s_all + 10000))::DOUBLE / ((s + 1) * (t_all + 10000))::DOUBLE))::BIGINT AS gain FROM counts, sums),
means AS (SELECT id, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM features JOIN hashed USING (f) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id),
scored AS (
  SELECT id AS doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS able,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN means USING (id) WHERE side = 'd'),
ranked AS (SELECT *, CASE WHEN able THEN row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) END AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * (SELECT count_if(able) FROM scored) // 100 THEN place END AS rank FROM ranked
"""

TURN = "'<|im_start|>' || {0} || chr(10) || {1} || '<|im_end|>' || chr(10)"
HIDDEN = "regexp_replace({0}, '<(\\\\*)\\|', '<\\1\\\\|', 'g')"
ROLE = HIDDEN.format("replace(replace(role, '%', '%25'), chr(10), '%0A')")

SQL["op13_reply_trees"] = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
told AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learned,
         sum(length({TURN.format(ROLE, HIDDEN.format("text"))}))::BIGINT AS formatted_chars
  FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM told
"""
