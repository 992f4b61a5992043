"""DuckDB SQL of the queries that SQL can express over whole tables.

Token ids (op1, op5), trained models (op10) and DOM trees (op8) have none; their
queries are tested against brute force.
"""

from __future__ import annotations

SPACES = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
SPLIT = r"'[\x20\x09-\x0D]+'"

# every row with its words as a list
WORDS = f"""
numbered AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, CASE WHEN trim(t, {SPACES}) = '' THEN CAST([] AS VARCHAR[])
      ELSE regexp_split_to_array(trim(t, {SPACES}), {SPLIT}) END AS words FROM numbered)"""

CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
written AS (
  SELECT *, 4 + 5 + 8 + length(replace(replace(replace(role, '\', '\b'), '#', '\h'), '<', '\l'))
    + length(replace(replace(replace(text, '\', '\b'), '#', '\h'), '<', '\l')) AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id
"""

QUALITY = f"""
WITH {WORDS},
windows AS (SELECT r, i, array_to_string(list_slice(words, i, i + 4), ' ') AS k
  FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM windows) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM w),
dup AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n
  FROM lines WHERE trim(line, {SPACES}) <> '' GROUP BY r),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(translate(t, {SPACES}, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, coalesce(dup.n_lines, 0) AS n_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT 100 * n_symbols > 20 * n_words AND NOT (word_chars < 2 * n_words OR word_chars > 20 * n_words)
  AND NOT (n_dup_lines >= 5 AND 100 * n_dup_lines > 50 * n_lines) AS kept
FROM b
"""

SUBSTRING = f"""
WITH {WORDS},
windows AS (SELECT r, doc_id, i, array_to_string(list_slice(words, i, i + 19), ' ') AS k
  FROM (SELECT r, doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20)),
ranked AS (SELECT r, i, rank() OVER (PARTITION BY k ORDER BY doc_id NULLS LAST, i) AS place FROM windows),
gone AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 20)) AS p FROM ranked WHERE place > 1)),
each AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w),
kept AS (SELECT each.r, string_agg(word, ' ' ORDER BY each.p) AS text
  FROM each LEFT JOIN gone ON each.r = gone.r AND each.p = gone.p WHERE gone.p IS NULL GROUP BY each.r),
n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r) LEFT JOIN n USING (r)
"""

NEAR = f"""
WITH RECURSIVE numbered AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS r, doc_id,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, doc_id, CASE WHEN trim(t, {SPACES}) = '' THEN CAST([] AS VARCHAR[])
      ELSE regexp_split_to_array(trim(t, {SPACES}), {SPLIT}) END AS words FROM numbered),
s AS (SELECT DISTINCT r, array_to_string(list_slice(words, i, i + 4), ' ') AS k
  FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT r, count(*) AS n, sha256(string_agg(k, chr(10) ORDER BY k)) AS class FROM s GROUP BY r),
one AS (SELECT class, min(r) AS r, any_value(n) AS n FROM n GROUP BY class),
o AS (SELECT s.r, s.k FROM s SEMI JOIN one USING (r)),
links AS (SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS shared FROM o x JOIN o y ON x.k = y.k AND x.r < y.r
    GROUP BY x.r, y.r) p JOIN one u ON u.r = a JOIN one v ON v.r = b
  WHERE 100 * shared >= 85 * (u.n + v.n - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
  UNION ALL SELECT one.r, n.r FROM n JOIN one USING (class) UNION ALL SELECT n.r, one.r FROM n JOIN one USING (class)),
reach AS (SELECT r AS a, r AS b FROM numbered UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
least AS (SELECT a AS r, min(doc_id) AS component_id FROM reach JOIN numbered ON numbered.r = reach.b GROUP BY a)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id,
  doc_id IS NOT DISTINCT FROM component_id AS kept
FROM numbered LEFT JOIN n USING (r) JOIN least USING (r)
"""

EXACT = f"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), {SPLIT}, ' ', 'g') AS t FROM documents),
g AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) AS place,
  min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(t) AS text_sha256 FROM g
"""

LETTERS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, {5 * k + 1}, 5) AS INTEGER) >> {s}) & 31), 1)"
    for k in range(8) for s in (15, 10, 5, 0))

WARC = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {LETTERS} AS payload_digest,
  max(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id < first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < first_id THEN first_id END AS refers_to
FROM g
"""

COLLOCATIONS = f"""
WITH t AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT r, lang, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i
  FROM (SELECT r, lang, regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]') AS pieces FROM t)),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS words FROM p),
g AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w),
grams AS (SELECT lang, k AS words, list_slice(words, i, i + k - 1) AS ids FROM g, (SELECT unnest([1, 2, 3, 4]) AS k)
  WHERE i + k - 1 <= len(words)),
f AS (SELECT lang, words, ids, count(*) AS a FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE words = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE words > 1 AND a >= 30),
cuts AS (SELECT lang, words, ids, a, unnest(range(1, words)) AS k FROM c),
s AS (SELECT cuts.*, x.a AS l, y.a AS r, (CAST(cuts.a AS HUGEINT) * 2000000) // (CAST(x.a AS HUGEINT) + y.a) AS score FROM cuts
  JOIN f x ON x.lang = cuts.lang AND x.ids = list_slice(cuts.ids, 1, k)
  JOIN f y ON y.lang = cuts.lang AND y.ids = list_slice(cuts.ids, k + 1, cuts.words)),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ids ORDER BY score, k) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.words > b.words
  AND 100 * CAST(c.a AS HUGEINT) >= 80 * CAST(b.a AS HUGEINT)
  AND (list_slice(c.ids, 1, b.words) = b.ids OR list_slice(c.ids, 2, b.words + 1) = b.ids
    OR c.words >= b.words + 2 AND list_slice(c.ids, 3, b.words + 2) = b.ids)))
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
  FROM (SELECT *, array_to_string(ids, ' ') AS phrase FROM kept)) JOIN n USING (lang) WHERE rank <= 2000
"""

ORACLE: dict[str, str] = {
    "op2_chat": CHAT,
    "op3_quality": QUALITY,
    "op4_warc": WARC,
    "op6_substring_dedup": SUBSTRING,
    "op7_minhash_dedup": NEAR,
    "op9_exact_dedup": EXACT,
    "op11_collocations": COLLOCATIONS,
}
