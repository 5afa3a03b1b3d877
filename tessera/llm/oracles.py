"""DuckDB SQL for the queries of this subpackage that SQL can express.

The other four (SentencePiece, classifier, token counts, alignment) are held
against a library, plain Python or known answers in tests/llm.
"""

_OP1 = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
n AS (SELECT doc_id, raw, octet_length(raw) AS n_bytes FROM b),
w AS (SELECT doc_id, pos, md5_number(raw[pos:pos + 199]) AS h FROM (SELECT doc_id, raw, unnest(range(1, n_bytes - 198)) AS pos FROM n)),
r AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
s AS (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM w SEMI JOIN r USING (h)),
g AS (SELECT doc_id, pos, sum(CASE WHEN before IS NULL OR pos - before > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM s),
c AS (SELECT doc_id, min(pos) AS first, max(pos) + 199 AS last FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, first, last, coalesce(lag(last) OVER (PARTITION BY doc_id ORDER BY first), 0) AS before FROM c),
t AS (SELECT doc_id, sum(last - first + 1) AS n_removed, count(*) AS n_spans, max(last) AS tail,
             string_agg(CASE WHEN first - before > 1 THEN hex(raw[before + 1:first - 1]) ELSE '' END, '' ORDER BY first) AS head
      FROM k JOIN n USING (doc_id) GROUP BY doc_id)
SELECT n.doc_id, n_bytes::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(CASE WHEN n_spans IS NULL THEN raw ELSE unhex(head || CASE WHEN tail < n_bytes THEN hex(raw[tail + 1:n_bytes]) ELSE '' END) END) AS kept_sha256
FROM n LEFT JOIN t USING (doc_id)
"""

_OP4 = r"""
WITH a AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM a),
g AS (SELECT doc_id, pos, w[pos] AS word, CASE WHEN pos + 49 <= len(w) THEN md5(array_to_string(w[pos:pos + 49], ' ')) END AS gram FROM x),
m AS (SELECT gram, min(doc_id) AS keeper FROM g WHERE gram IS NOT NULL GROUP BY gram),
h AS (SELECT g.doc_id, g.pos, g.word, coalesce(m.keeper < g.doc_id, false) AS hit FROM g LEFT JOIN m USING (gram)),
c AS (SELECT doc_id, pos, word, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM h),
t AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM c GROUP BY doc_id)
SELECT a.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM a LEFT JOIN t USING (doc_id)
"""

_OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS n, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM d
"""

_OP7 = r"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, w FROM a),
g AS (SELECT doc_id, pos, CASE WHEN pos + 2 <= len(w) THEN w[pos:pos + 2] END AS gram FROM x),
m AS (SELECT doc_id, pos, gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS twice FROM g),
c AS (SELECT doc_id, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM m),
r AS (SELECT doc_id, count(*) FILTER (WHERE hit) AS n FROM c GROUP BY doc_id),
k AS (SELECT a.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
             len(lines) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper
      FROM a LEFT JOIN r USING (doc_id)),
f AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (100 * n_symbols > 20 * n_words)::BIGINT
             + 8 * (100 * n_dup_lines > 50 * n_lines)::BIGINT + 16 * (100 * word_chars < 150 * n_words)::BIGINT
             + 32 * (word_chars > 20 * n_words)::BIGINT + 64 * (100 * n_upper > 50 * word_chars)::BIGINT AS failed FROM k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""

_OP8 = r"""
WITH RECURSIVE a AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                     ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS grams FROM a),
c AS (SELECT grams, min(doc_id) AS id, len(grams) AS n FROM s WHERE len(grams) > 0 GROUP BY grams),
g AS (SELECT id, n, unnest(grams) AS gram FROM c),
o AS (SELECT id, n, gram, row_number() OVER (PARTITION BY id ORDER BY df, gram) AS pos FROM g JOIN (SELECT gram, count(*) AS df FROM g GROUP BY gram) USING (gram)),
-- the rarest shingles of a set: two sets at 85 % share one of them
p AS (SELECT * FROM o WHERE pos <= n - (85 * n + 99) // 100 + 1),
q AS (SELECT DISTINCT x.id AS u, y.id AS v FROM p x JOIN p y ON x.gram = y.gram AND x.id < y.id AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)),
l AS (SELECT u, v FROM q JOIN c x ON x.id = q.u JOIN c y ON y.id = q.v
      WHERE 185 * len(list_intersect(x.grams, y.grams)) >= 85 * (x.n + y.n)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
reach AS (SELECT id AS start, id AS seen FROM c UNION SELECT start, v FROM reach JOIN e ON e.u = reach.seen),
k AS (SELECT start AS id, min(seen) AS component_id FROM reach GROUP BY start)
SELECT s.doc_id, len(s.grams)::BIGINT AS n_shingles, coalesce(k.component_id, s.doc_id) AS component_id, coalesce(k.component_id, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON c.grams = s.grams LEFT JOIN k ON k.id = c.id
"""

_OP10 = """
WITH a AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
x AS (SELECT doc_id, pos, lines[pos] AS line, translate(trim(lines[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos FROM a)),
k AS (SELECT key, max(doc_id) AS keeper FROM x WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
d AS (SELECT x.*, k.keeper IS NOT NULL AND k.keeper <> x.doc_id AS gone FROM x LEFT JOIN k USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""

SQL: dict[str, str] = {
    "op1_suffix_array_dedup": _OP1,
    "op4_substring_dedup": _OP4,
    "op6_warc": _OP6,
    "op7_quality_rules": _OP7,
    "op8_minhash_forest": _OP8,
    "op10_line_dedup": _OP10,
}
