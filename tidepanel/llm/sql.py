"""DuckDB statements that return what the corpus queries return, written without their methods."""

OP1 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), places AS (
  SELECT r, i, array_to_string(w[i : i + 4], ' ') AS span FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d)
), again AS (
  SELECT r, count(DISTINCT j) AS n FROM (
    SELECT p.r, unnest(range(p.i, p.i + 5)) AS j
    FROM places p JOIN (SELECT r, span FROM places GROUP BY r, span HAVING count(*) > 1) q ON p.r = q.r AND p.span = q.span
  ) GROUP BY r
), raw_lines AS (
  SELECT r, source, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         array_to_string(regexp_extract_all(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '[^\x20\x09-\x0D]+'), ' ') AS folded
  FROM (SELECT r, source, unnest(string_split(text, chr(10))) AS line FROM d)
), held AS (SELECT * FROM raw_lines WHERE n > 0),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM held GROUP BY r),
hosts AS (SELECT source, count(*) AS docs FROM documents GROUP BY source),
common AS (
  SELECT h.source, h.folded FROM (SELECT source, folded, count(DISTINCT r) AS docs FROM held GROUP BY source, folded) h
  JOIN hosts ON h.source IS NOT DISTINCT FROM hosts.source
  WHERE h.docs >= 20 AND h.docs > CAST(0.08 AS DOUBLE) * hosts.docs
), gone AS (
  SELECT r, CAST(sum(n) AS BIGINT) AS n FROM held JOIN common c
  ON held.folded = c.folded AND held.source IS NOT DISTINCT FROM c.source GROUP BY r
), measured AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         coalesce(dup.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS removed_words
  FROM d LEFT JOIN again ON d.r = again.r LEFT JOIN dup ON d.r = dup.r LEFT JOIN gone ON d.r = gone.r
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_words - removed_words AS rest FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rest >= 10 AND rest >= CAST(0.3 AS DOUBLE) * n_words AS kept, removed_words
FROM judged
"""

OP3 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), grams AS MATERIALIZED (
  SELECT doc_id, span FROM (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 3) - 1], ' ') AS span
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS i FROM d WHERE len(w) > 0)
  )
), sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM grams a JOIN grams b ON a.span = b.span AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared.n >= 90 * (x.n + y.n - shared.n)
), edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON reach.other = edges.a
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id
FROM d LEFT JOIN sizes s ON d.doc_id = s.doc_id
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r ON d.doc_id = r.doc_id
"""

OP4 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || coalesce(md5(text), 'null')) AS place
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight
  FROM sized GROUP BY source
), levelled AS (
  SELECT *, 3 * sum(source_size) OVER () AS wanted,
         coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM sources WINDOW o AS (ORDER BY 2 * source_size / weight, source NULLS LAST)
), opened AS (
  SELECT *, 2 * source_size * weight_left * 2 > weight * (wanted - 2 * spent) AS is_open FROM levelled
), targets AS (
  SELECT source, source_size,
         CASE WHEN is_open THEN weight * CAST(wanted - 2 * coalesce(sum(2 * source_size) FILTER (NOT is_open) OVER (), 0) AS DOUBLE)
                                / (2 * sum(weight) FILTER (is_open) OVER ())
              ELSE CAST(2 * source_size AS DOUBLE) END AS target
  FROM opened
), whole AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM targets
), ordered AS (
  SELECT d.doc_id, d.size, d.source, w.source_size, w.target, w.times, w.target - w.times * w.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place) AS reached,
         sum(d.size) OVER (PARTITION BY d.source, d.place) AS here
  FROM sized d JOIN whole w ON d.source IS NOT DISTINCT FROM w.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (times + CASE WHEN rest > 0 AND 2 * (reached - here) + here <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       source,
       CAST(times + CASE WHEN rest > 0 AND 2 * (reached - here) + here <= 2 * rest THEN 1 ELSE 0 END AS INTEGER) AS times
FROM ordered
"""

OP8 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS span
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS span
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hits AS (
  SELECT p.r, p.n, p.i, x.item_id FROM places p JOIN windows x ON p.n = x.n AND p.span = x.span
), words AS (
  SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT r, n, i FROM hits))
  GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
  FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r
)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, coalesce(words.n_hit, 0) AS n_hit,
       coalesce(items.n_items, 0) AS n_items, sha256(coalesce(items.names, '')) AS items_sha256,
       coalesce(words.n_hit, 0) > 0 AND 20 * coalesce(words.n_hit, 0) >= coalesce(len(d.w), 0) AS contaminated
FROM d LEFT JOIN words ON d.r = words.r LEFT JOIN items ON d.r = items.r
"""

OP11 = r"""
WITH folded AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL
), d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM folded WHERE len(w) > 0),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), size AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
held AS MATERIALIZED (
  SELECT r, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT r, doc_id, n, unnest(w) AS term FROM d) GROUP BY r, doc_id, n, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM held, size WHERE term IN (SELECT term FROM asked) GROUP BY term, docs
), scored AS (
  SELECT item_id, r, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term), size GROUP BY item_id, r, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
) WHERE rank <= 50
"""

OP12 = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
         CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
  AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) <= 3
"""

OP13 = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93
), reach(node, root) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node
), counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(counted.n, 0) AS n_links, min(reach.root) AS component_id, e.vec_id = min(reach.root) AS kept
FROM embeddings e LEFT JOIN counted ON e.vec_id = counted.vec_id JOIN reach ON reach.node = e.vec_id
GROUP BY e.vec_id, counted.n
"""

ORACLES: dict[str, str] = {"op1_line_frequency": OP1, "op3_jaccard_components": OP3, "op4_source_mixture": OP4, "op8_benchmark_overlap": OP8,
                           "op11_accumulator_search": OP11, "op12_hard_negatives": OP12, "op13_similar_vectors": OP13}
