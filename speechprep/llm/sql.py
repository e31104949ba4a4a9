"""DuckDB SQL for the queries that SQL can express."""

EXACT_DEDUP = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""

#: Checksums, byte after byte, with the usual reflected polynomial; the table of 256 entries is made by rule.
SHARDING = r"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END) ORDER BY i) AS entry
  FROM range(256) r(i)),
t AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS pairs FROM documents),
bytes AS (
  SELECT doc_id, len(pairs) + 1 AS size,
    xor(4294967295::UBIGINT, list_reduce(
      list_prepend(4294967295::UBIGINT, list_transform(pairs, lambda p: ('0x' || p)::UBIGINT)),
      lambda c, b: xor(entry[((xor(c, b) & 255) + 1)::BIGINT], c >> 8))) AS text_crc32
  FROM t, crc_table),
line AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id) - size AS before, sum(size) OVER () AS total FROM bytes),
cut AS (
  SELECT *, least(15, ((2 * before + size) * 16) // (2 * total))::INTEGER AS shard FROM line)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM cut
"""

#: Shares in closed form: with sources by cap per weight, a prefix of them is capped.
MIXING = r"""
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source),
p AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weights,
         sum(3 * source_size) OVER o AS caps, sum(weight) OVER o AS weights
  FROM s WINDOW o AS (ORDER BY source_size / weight, source ROWS UNBOUNDED PRECEDING)),
q AS (
  SELECT *, (total - (caps - 3 * source_size))::DOUBLE / (all_weights - weights + weight)::DOUBLE AS here FROM p),
u AS (
  SELECT first(here ORDER BY source_size / weight, source) AS unit FROM q WHERE here * weight < 3 * source_size),
r AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, coalesce(unit, 1e300) * weight) AS target,
         ('0x' || md5('mix:' || coalesce('s:' || source, 'null'))[1:6])::BIGINT AS shift
  FROM q, u),
n AS (
  SELECT d.*, source_size, target, shift,
         CASE WHEN source_size > 0 THEN round(target / source_size * 16777216)::BIGINT ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id) - 1 AS idx
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       size * (((idx + 1) * rate + shift) // 16777216 - (idx * rate + shift) // 16777216) AS taken
FROM n
"""

#: All pairs of a label; components by spreading the smallest id along links.
EMBEDDING_NEAR_DEDUP = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
reach AS (
  SELECT vec_id AS node, vec_id AS root FROM embeddings
  UNION
  SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node),
c AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON node = vec_id LEFT JOIN n ON a = vec_id
"""

LEXICAL_SEARCH = r"""
WITH words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
corpus AS (SELECT count(*)::BIGINT AS all_docs, sum(len(terms))::BIGINT AS all_terms FROM words WHERE len(terms) > 0),
held AS (
  SELECT doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM words) GROUP BY ALL),
weight AS (
  SELECT term, floor(1000 * ln((2 * all_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM held, corpus GROUP BY term, all_docs),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
times AS (SELECT item_id, term, count(*)::BIGINT AS times FROM asked GROUP BY ALL),
scored AS (
  SELECT item_id, doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * all_docs) // all_terms))))::BIGINT AS score
  FROM times JOIN weight USING (term) JOIN held USING (term), corpus GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20
"""

#: Near words by what is left when one letter is taken out: at the same place for a replaced one.
SPELLING_VARIANTS = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END) ORDER BY i) AS entry
  FROM range(256) r(i)),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
counted AS MATERIALIZED (
  SELECT run, count(*) AS times, regexp_extract_all(hex(encode(doc_id || ':' || run)), '..') AS pairs
  FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
hashed AS (
  SELECT run, times, xor(4294967295::UBIGINT, list_reduce(
      list_prepend(4294967295::UBIGINT, list_transform(pairs, lambda p: ('0x' || p)::UBIGINT)),
      lambda c, b: xor(entry[((xor(c, b) & 255) + 1)::BIGINT], c >> 8)))::BIGINT AS h
  FROM counted, crc_table),
slipped AS (
  SELECT CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, times
  FROM hashed),
w AS MATERIALIZED (
  SELECT word, sum(times)::BIGINT AS n FROM slipped GROUP BY word HAVING length(word) >= 6 AND sum(times) >= 5),
less AS MATERIALIZED (
  SELECT word, n, place, word[1:place - 1] || word[place + 1:] AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS place FROM w)),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.rest = b.rest AND a.place = b.place AND a.word <> b.word
  UNION SELECT less.word, w.word FROM less JOIN w ON less.rest = w.word
  UNION SELECT w.word, less.word FROM less JOIN w ON less.rest = w.word),
near AS (
  SELECT a AS word, count(*) AS n_near, first(b ORDER BY w.n DESC, b) AS best, max(w.n) AS most
  FROM pairs JOIN w ON w.word = b GROUP BY a),
formed AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * n THEN best END AS form,
         CASE WHEN most >= 5 * n THEN most END AS form_n
  FROM w LEFT JOIN near USING (word)),
walk AS (
  SELECT word, word AS at FROM formed
  UNION ALL
  SELECT walk.word, formed.form FROM walk JOIN formed ON formed.word = walk.at WHERE formed.form IS NOT NULL)
SELECT formed.word, formed.n, formed.n_near::BIGINT AS n_near, formed.form, formed.form_n::BIGINT AS form_n, walk.at AS root
FROM formed JOIN walk ON walk.word = formed.word JOIN formed last ON last.word = walk.at AND last.form IS NULL
"""

SQL = {"op1_exact_dedup": EXACT_DEDUP, "op4_sharding": SHARDING, "op10_mixing": MIXING}
SQL |= {
    "op11_embedding_near_dedup": EMBEDDING_NEAR_DEDUP,
    "op12_lexical_search": LEXICAL_SEARCH,
    "op13_spelling_variants": SPELLING_VARIANTS,
}
