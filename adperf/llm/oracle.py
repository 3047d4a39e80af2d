"""DuckDB SQL for the queries that SQL can express on whole tables.

op3, op6, op7, op9 and op11 (tokenizer libraries, bin packing, a fitted model) and op4
(checksums over trimmed prefixes with context scores) are tested against
brute-force versions instead, and so is the pipeline.
"""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP1 = """
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, text, 'c' || conv_id || '-' || turn AS call_id,
         CASE turn % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'summarise' ELSE 'translate' END AS name,
         CASE WHEN turn > 1 THEN 'c' || conv_id || '-' || (turn // 2) END AS parent
  FROM conversations WHERE role = 'assistant'),
nodes AS (SELECT DISTINCT call_id FROM calls WHERE call_id IS NOT NULL),
edges AS (SELECT DISTINCT call_id, parent FROM calls WHERE parent IS NOT NULL),
lv(call_id, level) AS (
  SELECT call_id, 0 FROM nodes
  UNION
  SELECT e.call_id, lv.level + 1 FROM lv JOIN edges e ON e.parent = lv.call_id),
level AS (SELECT call_id, max(level) AS level FROM lv GROUP BY call_id),
results AS (
  SELECT 'c' || conv_id || '-' || (turn - 1) AS call_id, min(text) AS result, count(*) AS n
  FROM conversations WHERE role = 'user' AND turn > 0 GROUP BY 1),
rows AS (
  SELECT c.*, level.level, results.result, coalesce(results.n, 0) AS n_results,
         CASE WHEN c.parent IS NOT NULL AND c.parent NOT IN (SELECT call_id FROM nodes) THEN 1 ELSE 0 END AS n_missing,
         concat_ws('; ',
           CASE WHEN text IS NULL AND name <> 'translate' THEN '$.chars: missing'
                WHEN name = 'search' AND length(text) > 1500 THEN '$.chars: above maximum'
                WHEN name = 'summarise' AND length(text) < 300 THEN '$.chars: below minimum' END,
           CASE WHEN text IS NULL THEN '$.text: missing'
                WHEN name = 'summarise' AND length(text) = 0 THEN '$.text: too short' END) AS errors
  FROM calls c LEFT JOIN level USING (call_id) LEFT JOIN results USING (call_id))
SELECT CAST(conv_id AS BIGINT) AS conv_id, call_id, name, CAST(level AS INTEGER) AS level, CAST(n_missing AS BIGINT) AS n_missing,
       CAST(n_results AS BIGINT) AS n_results, errors = '' AS valid, errors,
       '{"arguments":' || CASE WHEN text IS NULL THEN '{"turn":' || turn || '}'
          ELSE '{"chars":' || length(text) || ',"text":' || CAST(to_json(text) AS VARCHAR) || ',"turn":' || turn || '}' END
       || ',"call_id":"' || call_id || '","name":"' || name || '","result":' || coalesce(CAST(to_json(result) AS VARCHAR), 'null') || '}' AS message
FROM rows
"""

OP2 = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {LOWER} AS t FROM documents) WINDOW w AS (PARTITION BY t)
"""

OP5 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, sum(least(8, i - before)) AS n
        FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - 8) AS before FROM dup) GROUP BY doc_id),
base AS (
  SELECT d.doc_id, d.source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
         length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM d LEFT JOIN cov USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS docs, count(*) FILTER (base_failed) AS failures FROM judged GROUP BY source),
sums AS (SELECT sum(docs) AS n, sum(failures) / sum(docs) AS m, sum(failures * failures / docs) AS s, sum(docs * docs) AS nn, count(*) - 1 AS k FROM hosts),
prior AS (SELECT m, ((s - n * m * m) / nullif(m * (1 - m), 0) - k) / nullif(greatest(n - nn / n - k, 0), 0) AS b FROM sums),
weighed AS (SELECT hosts.*, m, CASE WHEN b > 0 THEN 1 / least(b, 1) - 1 END AS k FROM hosts, prior),
verdict AS (SELECT source, coalesce((failures + k * m) / (docs + k), m) > 0.5 AS rejected FROM weighed)
SELECT j.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       base_failed, NOT base_failed AND NOT rejected AS kept
FROM judged j JOIN verdict v ON j.source IS NOT DISTINCT FROM v.source
"""

OP8 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
pairs AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT links.y, reach.c FROM reach JOIN links ON links.x = reach.doc_id),
comp AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
SELECT documents.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, documents.doc_id = component_id AS kept
FROM documents JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP10 = rf"""
WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1),
marked AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 35 THEN 0 ELSE 1 END AS new FROM dup),
parts AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM marked),
islands AS (SELECT doc_id, min(i) AS lo, max(i) + 34 AS hi FROM parts GROUP BY doc_id, part),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS t FROM words
         WHERE NOT EXISTS (SELECT 1 FROM islands WHERE islands.doc_id = words.doc_id AND j BETWEEN lo AND hi) GROUP BY doc_id),
gone AS (SELECT doc_id, sum(hi - lo + 1) AS n FROM islands GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP12 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5),
neg AS (
  SELECT pos.anchor AS anchor_id, pos.other AS positive_id, n.other AS negative_id, pos.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY pos.anchor, pos.other ORDER BY n.score DESC, n.other) AS r
  FROM pos JOIN pairs n ON n.anchor = pos.anchor AND NOT n.same AND 30 * pos.score <= 100 * n.score AND 100 * n.score <= 90 * pos.score)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE r <= 10
"""

_HEX = "(instr('0123456789abcdef', substr(h, {0} + 1, 1)) - 1)"
#: Five bits of the hex digest from bit 5 i on, as a base-32 letter (20 bytes are exactly 32 letters).
_LETTER = f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((({_HEX.format('(5 * i) // 4')} * 16 + {_HEX.format('(5 * i) // 4 + 1')}) >> (3 - (5 * i) % 4)) & 31), 1)"

OP13 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, max(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: {_LETTER}), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""

ORACLE = {
    "op1_tool_calls": OP1, "op2_exact_dedup": OP2, "op5_host_quality": OP5, "op8_minhash": OP8, "op10_substring_dedup": OP10,
    "op12_hard_negatives": OP12, "op13_warc": OP13,
}
